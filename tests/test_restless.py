"""A restless list widens its fence, and the fence still judges its values."""

import json

from pyspark.sql import functions as F

from tidegrid.operators import spikes
from tidegrid.plans.odds_tables import READING_PRICES


def test_spike_in_a_restless_list(spark):
    def payload(home):
        return json.dumps({"bookmakerName": "B", "runningOdds": [{"home": str(h), "draw": 3.1 + 0.01 * (i % 2), "away": "4.0", "time": "05-01 10:00"} for i, h in enumerate(home)]})

    wild = [2.0, 2.3, 1.9, 2.2, 1.8, 2.4, 1.9, 2.2, 2.0, 2.3, 1.9, 2.1] * 2
    rows = [(1, 10, payload(wild)), (2, 11, payload([*wild[:12], 40.0, *wild[12:]]))]
    df = spark.createDataFrame(rows, "id long, schedule_id long, payload string").withColumn("created_at", F.to_timestamp(F.lit("2024-06-01")))
    assert [(r["id"], r["seq"]) for r in spikes.flag_readings(df, "payload", READING_PRICES).where("spike").collect()] == [(2, 12)]
