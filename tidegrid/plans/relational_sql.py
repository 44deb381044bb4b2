"""The queries of ``relational`` once more, as SQL for the oracle: written from what they mean, not from how they are built."""

from __future__ import annotations

_H, _A = "try_cast(split_part({0}, '-', 1) AS INT)", "try_cast(split_part({0}, '-', 2) AS INT)"


def goals(column: str) -> tuple[str, str]:
    return _H.format(column), _A.format(column)


def result(column: str, labels: tuple[str, str, str], rest: str) -> str:
    """The outcome of a score; ``rest`` for a missing or malformed one."""
    h, a = goals(column)
    return f"CASE WHEN {h} > {a} THEN '{labels[0]}' WHEN {h} < {a} THEN '{labels[2]}' WHEN {h} = {a} THEN '{labels[1]}' ELSE {rest} END"


VIEW_RESULT = result("lm.final_score", ("主胜", "平局", "客胜"), "'平局'")
OUTCOME = result("final_score", ("home", "draw", "away"), "NULL")
HDA = result("final_score", ("H", "D", "A"), "'D'")
#: Key of a handicap bookmaker as the other tables write it.
CANONICAL = "CASE th.bookmaker WHEN 'bet365' THEN 'Bet 365' WHEN 'easybets' THEN 'Easybets' ELSE th.bookmaker END"
#: The latest row of each match (keep-last upsert).
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS rn FROM league_matches) ranked WHERE rn = 1)"
ENCODED = "SELECT s.id, s.bookmaker, s.match_id, s.sax_interleaved AS code, l.final_score, " + OUTCOME.replace("final_score", "l.final_score") + f" AS outcome FROM sax_encoding s JOIN {LATEST} l ON l.match_id = s.match_id"
SCORED = f"SELECT * FROM ({ENCODED}) e WHERE outcome IS NOT NULL AND code IS NOT NULL AND code <> ''"


def patterns(code: str, support: int, purity: float, source: str = SCORED) -> str:
    """Pattern statistics: outcomes per code, purity and the dominant outcome (ties: home, draw, away)."""
    return f"""SELECT bookmaker, pattern, total, home, draw, away, greatest(home, draw, away) / total AS purity,
      CASE WHEN home >= draw AND home >= away THEN 'home' WHEN draw >= away THEN 'draw' ELSE 'away' END AS dominant, first_seen
    FROM (SELECT bookmaker, {code} AS pattern, count(*) AS total, count(CASE WHEN outcome = 'home' THEN 1 END) AS home,
      count(CASE WHEN outcome = 'draw' THEN 1 END) AS draw, count(CASE WHEN outcome = 'away' THEN 1 END) AS away, min(id) AS first_seen
      FROM ({source}) scored GROUP BY bookmaker, {code}) counted
    WHERE total >= {support} AND greatest(home, draw, away) / total >= {purity}"""


ORACLE: dict[str, str] = {
    # projections
    "ref_p01_view_projection": "SELECT schedule_id AS match_id, bookmaker_name AS bookmaker, final_win, final_draw, final_lose FROM betting_odds",
    "ref_p02_result_case": f"SELECT match_id, final_score, {VIEW_RESULT} AS result FROM league_matches lm",
    "ref_p03_canonical_key": f"SELECT id, match_id, {CANONICAL} AS bookmaker FROM total_handicap th",
    "ref_p04_alias": "SELECT id, CASE WHEN lower(bookmaker) IN ('bet365', 'bet 365', '36*') THEN 'Bet 365' WHEN lower(bookmaker) IN ('easybets', 'yi') THEN 'Easybets' ELSE bookmaker END AS bookmaker FROM total_handicap",
    "ref_p05_slug": "SELECT id, replace(replace(lower(bookmaker_name), ' ', '_'), '/', '_') AS slug FROM betting_odds",
    "ref_p06_upload_record": "SELECT bookmaker, match_id, season, sax_interleaved, sax_delta, home_mean, draw_mean, away_mean, running_odds_count FROM sax_encoding WHERE coalesce(sax_interleaved, '') <> '' OR coalesce(sax_delta, '') <> ''",
    "ref_p08_defaults": "SELECT id, coalesce(nullif(league_id, 0), -1) AS league_id, coalesce(home_team_name, concat('Unknown (', CAST(home_team_id AS VARCHAR(20)), ')')) AS home_team_name FROM league_matches",
    # filters
    "ref_f01_equality": "SELECT id, schedule_id, final_win FROM betting_odds WHERE bookmaker_name = 'Bet 365'",
    "ref_f02_price_range": "SELECT id, schedule_id, final_win FROM betting_odds WHERE final_win BETWEEN 1.80 AND 2.20",
    "ref_f03_not_null": "SELECT id, match_id, final_score FROM league_matches WHERE final_score IS NOT NULL",
    "ref_f04_whitelist": "SELECT id, bookmaker_name FROM betting_odds WHERE bookmaker_name IN ('William Hill', 'Bet 365', 'Easybets', 'Lottery Official', 'Macauslot')",
    "ref_f05_valid_prices": "SELECT id, final_win, final_draw, final_lose FROM betting_odds WHERE final_win > 0 AND final_draw > 0 AND final_lose > 0",
    "ref_f06_min_length": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 2",
    "ref_f07_all_valid": "SELECT schedule_id, count(*) AS n_rows, count(CASE WHEN final_win IS NULL OR final_draw IS NULL OR final_lose IS NULL THEN 1 END) AS n_bad, CASE WHEN count(CASE WHEN final_win IS NULL OR final_draw IS NULL OR final_lose IS NULL THEN 1 END) = 0 THEN 1 ELSE 0 END AS used FROM betting_odds WHERE schedule_id IS NOT NULL GROUP BY schedule_id",
    "ref_f10_nonempty_code": "SELECT id, sax_interleaved FROM sax_encoding WHERE coalesce(sax_interleaved, '') <> ''",
    "ref_f11_min_support": f"SELECT code, count(*) AS n FROM ({ENCODED}) e GROUP BY code HAVING count(*) >= 5",
    "ref_f12_purity": f"SELECT bookmaker, pattern, total, round(purity, 6) AS purity FROM ({patterns('code', 3, 0.65)}) p",
    "ref_f14_line_present": f"SELECT t.id, h.line_value FROM total_handicap t JOIN handicap_lines h ON h.line_name = t.handicap JOIN {LATEST} l ON l.match_id = t.match_id WHERE h.line_value <> 0 AND l.final_score IS NOT NULL",
    "ref_f15_skip_existing": "SELECT l.id, l.match_id FROM league_matches l WHERE NOT EXISTS (SELECT 1 FROM total_handicap t WHERE t.match_id = l.match_id)",
    "ref_f17_minute_dedupe": "SELECT user_id, date_trunc('minute', ts) AS minute, min(event_id) AS first_event FROM events GROUP BY user_id, date_trunc('minute', ts)",
    # joins
    "ref_j01_matches_odds": f"SELECT lm.match_id, lm.league_name, lm.season, bo.bookmaker_name, bo.final_win, bo.final_draw, bo.final_lose, lm.final_score, {VIEW_RESULT} AS result FROM league_matches lm JOIN betting_odds bo ON lm.match_id = bo.schedule_id",
    "ref_j02_odds_encoding": "SELECT bo.schedule_id, bo.bookmaker_name, bo.final_win, s.sax_interleaved, s.sax_delta FROM betting_odds bo JOIN sax_encoding s ON s.match_id = bo.schedule_id AND s.bookmaker = bo.bookmaker_name",
    "ref_j03_encoding_results": "SELECT s.id, s.bookmaker, s.match_id, s.sax_interleaved, bo.final_win, lm.final_score FROM betting_odds bo JOIN sax_encoding s ON s.match_id = bo.schedule_id AND s.bookmaker = bo.bookmaker_name LEFT JOIN league_matches lm ON lm.match_id = s.match_id",
    "ref_j04_encoding_handicap": f"SELECT s.id, s.bookmaker, s.match_id, s.sax_interleaved, bo.final_win, lm.final_score, th.handicap AS init_handicap, th.final_handicap, th.init_odds_home, th.final_odds_home FROM betting_odds bo JOIN sax_encoding s ON s.match_id = bo.schedule_id AND s.bookmaker = bo.bookmaker_name LEFT JOIN league_matches lm ON lm.match_id = s.match_id LEFT JOIN total_handicap th ON th.match_id = s.match_id AND s.bookmaker = {CANONICAL}",
    "ref_j05_attach_score": f"SELECT s.id, s.match_id, l.final_score FROM sax_encoding s LEFT JOIN {LATEST} l ON l.match_id = s.match_id",
    "ref_j06_common_matches": "SELECT a.match_id, min(a.sax_interleaved) AS code_a, min(b.sax_interleaved) AS code_b FROM sax_encoding a JOIN sax_encoding b ON a.match_id = b.match_id WHERE a.bookmaker = 'Bet 365' AND b.bookmaker = 'Easybets' GROUP BY a.match_id",
    "ref_j07_library_lookup": f"WITH lib AS ({patterns('substring(code, 1, 3)', 5, 0.5)}) SELECT e.id, lib.dominant AS prediction, e.outcome FROM ({SCORED}) e LEFT JOIN lib ON lib.bookmaker = e.bookmaker AND lib.pattern = substring(e.code, 1, 3)",
    "ref_j10_team_names": "SELECT m.id, coalesce(t.name, concat('Unknown (', CAST(m.home_team_id AS VARCHAR), ')')) AS home_name FROM league_matches m LEFT JOIN (SELECT home_team_id AS team_id, home_team_name AS name FROM league_matches WHERE home_team_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY home_team_id ORDER BY created_at DESC, id DESC) = 1) t ON t.team_id = m.home_team_id",
    "ref_j15_sources_by_id": "SELECT l.match_id, CASE WHEN o.schedule_id IS NULL THEN 0 ELSE 1 END AS has_odds, CASE WHEN h.match_id IS NULL THEN 0 ELSE 1 END AS has_handicap FROM (SELECT DISTINCT match_id FROM league_matches) l LEFT JOIN (SELECT DISTINCT schedule_id FROM match_odds) o ON o.schedule_id = l.match_id LEFT JOIN (SELECT DISTINCT match_id FROM total_handicap) h ON h.match_id = l.match_id",
    # aggregates
    "ref_a01_outcome_rates": "SELECT bookmaker_name, count(*) AS total, count(CASE WHEN h > a THEN 1 END) AS wins, count(CASE WHEN h = a THEN 1 END) AS draws, count(CASE WHEN coalesce(h > a, false) OR coalesce(h = a, false) THEN NULL ELSE 1 END) AS losses, printf('%.2f%%', round(100.0 * count(CASE WHEN h > a THEN 1 END) / count(*), 2)) AS win_pct FROM (SELECT bo.bookmaker_name, {0} AS h, {1} AS a FROM betting_odds bo JOIN league_matches lm ON lm.match_id = bo.schedule_id WHERE lm.final_score IS NOT NULL AND bo.final_win BETWEEN 1.5 AND 2.5) x GROUP BY bookmaker_name".format(*goals("lm.final_score")),
    "ref_a03_pattern_stats": f"SELECT bookmaker, pattern, total, home, draw, away, round(purity, 6) AS purity, dominant FROM ({patterns('substring(code, 1, 4)', 3, 0.0)}) p",
    "ref_a04_strategy_summary": f"WITH p AS ({patterns('substring(code, 1, 4)', 3, 0.0)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY bookmaker ORDER BY purity DESC, total DESC, pattern) AS r FROM p) SELECT bookmaker, count(*) AS n_patterns, CAST(sum(total) AS BIGINT) AS supported, round(avg(CASE WHEN r <= 20 THEN purity END), 6) AS top_purity, round(sum(CASE WHEN r <= 20 THEN total ELSE 0 END) / sum(total), 6) AS top_coverage, count(CASE WHEN purity >= 0.7 THEN 1 END) AS n_pure, round(sum(CASE WHEN purity >= 0.7 THEN total ELSE 0 END) / sum(total), 6) AS pure_coverage FROM ranked GROUP BY bookmaker",
    "ref_a05_coverage_of_all": f"WITH p AS ({patterns('substring(code, 1, 4)', 3, 0.0)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY bookmaker ORDER BY total DESC, purity DESC, pattern) AS r FROM p), n AS (SELECT bookmaker, count(*) AS matches FROM ({SCORED}) s GROUP BY bookmaker) SELECT ranked.bookmaker, round(sum(CASE WHEN r <= 20 THEN total ELSE 0 END) / max(matches), 6) AS coverage FROM ranked JOIN n ON n.bookmaker = ranked.bookmaker GROUP BY ranked.bookmaker",
    "ref_a06_two_level_patterns": f"""WITH base AS ({SCORED}), coarse AS ({patterns('substring(code, 1, 2)', 5, 0.0)}),
      fine AS ({patterns('substring(code, 1, 4)', 5, 0.65, f"SELECT b.* FROM ({SCORED}) b JOIN ({patterns('substring(code, 1, 2)', 5, 0.0)}) c ON c.bookmaker = b.bookmaker AND c.pattern = substring(b.code, 1, 2) WHERE c.purity < 0.7")})
      SELECT 'coarse' AS level, bookmaker, pattern, total, round(purity, 6) AS purity, dominant FROM coarse WHERE purity >= 0.7
      UNION ALL SELECT 'fine', bookmaker, pattern, total, round(purity, 6), dominant FROM fine""",
    "ref_a07_library_accuracy": f"WITH lib AS ({patterns('substring(code, 1, 3)', 5, 0.45)}) SELECT e.bookmaker, count(*) AS matches, count(lib.pattern) AS covered, count(CASE WHEN lib.dominant = e.outcome THEN 1 END) AS right_ones, count(CASE WHEN lib.purity >= 0.70 THEN 1 END) AS high_confidence FROM ({SCORED}) e LEFT JOIN lib ON lib.bookmaker = e.bookmaker AND lib.pattern = substring(e.code, 1, 3) GROUP BY e.bookmaker",
    "ref_a08_fusion": f"""WITH lib AS ({patterns('substring(code, 1, 3)', 5, 0.45)}),
      one AS (SELECT bookmaker, match_id, min(code) AS code, min(outcome) AS outcome FROM ({SCORED}) s GROUP BY bookmaker, match_id),
      looked AS (SELECT o.bookmaker, o.match_id, o.outcome, lib.dominant AS p FROM one o LEFT JOIN lib ON lib.bookmaker = o.bookmaker AND lib.pattern = substring(o.code, 1, 3)),
      pair AS (SELECT a.match_id, a.outcome, a.p AS pa, b.p AS pb FROM looked a JOIN looked b ON a.match_id = b.match_id WHERE a.bookmaker = 'Bet 365' AND b.bookmaker = 'Easybets')
      SELECT CASE WHEN pa IS NOT NULL AND pb IS NOT NULL AND pa = pb THEN 'both_high' WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 'disagree' WHEN pa IS NULL AND pb IS NULL THEN 'both_low' ELSE 'single_high' END AS kind,
        count(*) AS n, count(CASE WHEN coalesce(pa, pb) = outcome THEN 1 END) AS right_ones FROM pair GROUP BY 1""",
    "ref_a09_tallies": "SELECT league_name, season, count(*) AS n FROM league_matches GROUP BY league_name, season",
    "ref_a10_top_words": "SELECT bookmaker, code, n FROM (SELECT bookmaker, sax_interleaved AS code, count(*) AS n, row_number() OVER (PARTITION BY bookmaker ORDER BY count(*) DESC, min(id)) AS r FROM sax_encoding WHERE sax_interleaved IS NOT NULL GROUP BY bookmaker, sax_interleaved) x WHERE r <= 5",
    "ref_a11_profile": """WITH priced AS (SELECT schedule_id, bookmaker_name, final_win, final_draw, final_lose FROM betting_odds QUALIFY row_number() OVER (PARTITION BY schedule_id, bookmaker_name ORDER BY id DESC) = 1),
      c AS (SELECT s.bookmaker, left(s.sax_interleaved, 1) AS cluster, left(s.sax_interleaved, 8) AS head, final_win, final_draw, final_lose FROM sax_encoding s LEFT JOIN priced p ON p.schedule_id = s.match_id AND p.bookmaker_name = s.bookmaker WHERE s.sax_interleaved <> ''),
      h AS (SELECT bookmaker, cluster, head, count(*) AS k, row_number() OVER (PARTITION BY bookmaker, cluster ORDER BY count(*) DESC, head) AS r FROM c GROUP BY bookmaker, cluster, head),
      top AS (SELECT bookmaker, cluster, string_agg(head || ':' || k, ' ' ORDER BY r) AS prefixes FROM h WHERE r <= 5 GROUP BY bookmaker, cluster)
      SELECT c.bookmaker, c.cluster, count(*) AS n, round(avg(CAST(nullif(final_win, 0) AS DOUBLE)), 9) AS mean_final_win, round(avg(CAST(nullif(final_draw, 0) AS DOUBLE)), 9) AS mean_final_draw, round(avg(CAST(nullif(final_lose, 0) AS DOUBLE)), 9) AS mean_final_lose, any_value(prefixes) AS prefixes
      FROM c JOIN top ON top.bookmaker = c.bookmaker AND top.cluster = c.cluster GROUP BY c.bookmaker, c.cluster""",
    "ref_a12_prefix_rates": f"SELECT left(code, 8) AS prefix, count(*) AS total, round(avg(CASE WHEN outcome = 'home' THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(avg(CASE WHEN outcome = 'draw' THEN 1e0 ELSE 0e0 END), 6) AS draw_rate, round(avg(CASE WHEN outcome = 'away' THEN 1e0 ELSE 0e0 END), 6) AS loss_rate FROM ({ENCODED}) e WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) >= 10",
    "ref_a13_series_stats": "SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS dev FROM events GROUP BY user_id",
    "ref_a14_length_percentiles": "SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY n) AS p25, percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS p50, percentile_cont(0.75) WITHIN GROUP (ORDER BY n) AS p75, percentile_cont(0.9) WITHIN GROUP (ORDER BY n) AS p90, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS longest FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id) x",
    "ref_a19_recommendation": "SELECT bookmaker, CASE WHEN med < 15 THEN 6 WHEN med > 30 THEN 10 ELSE 8 END AS word_size, 4 AS alphabet_size, CAST(floor(greatest(32, p90)) AS BIGINT) AS interpolate_len FROM (SELECT bookmaker, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(running_odds_count AS DOUBLE)) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY CAST(running_odds_count AS DOUBLE)) AS p90 FROM sax_encoding GROUP BY bookmaker) x",
    "ref_a21_pooled": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS dev, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "ref_a24_accuracy": f"WITH lib AS ({patterns('substring(code, 1, 3)', 5, 0.0)}) SELECT e.bookmaker, round(avg(CASE WHEN lib.dominant = e.outcome THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM ({SCORED}) e JOIN lib ON lib.bookmaker = e.bookmaker AND lib.pattern = substring(e.code, 1, 3) GROUP BY e.bookmaker",
    "ref_a25_threshold_accuracy": f"WITH lib AS ({patterns('substring(code, 1, 3)', 3, 0.0)}), t AS (SELECT 0.3 AS threshold UNION ALL SELECT 0.4 UNION ALL SELECT 0.5 UNION ALL SELECT 0.6 UNION ALL SELECT 0.7) SELECT CAST(t.threshold AS DOUBLE) AS threshold, count(*) AS n, round(avg(CASE WHEN lib.dominant = e.outcome THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM ({SCORED}) e JOIN lib ON lib.bookmaker = e.bookmaker AND lib.pattern = substring(e.code, 1, 3) JOIN t ON lib.purity >= t.threshold GROUP BY t.threshold",
    "ref_a26_label_tallies": f"SELECT count(CASE WHEN r = 'H' THEN 1 END) AS h, count(CASE WHEN r = 'D' THEN 1 END) AS d, count(CASE WHEN r = 'A' THEN 1 END) AS a FROM (SELECT {HDA} AS r FROM league_matches) x",
    "ref_a27_row_count": "SELECT count(*) AS n FROM betting_odds",
    "ref_a28_best_strategy": f"""WITH g AS (SELECT n AS strategy, left(code, n) AS pattern, count(*) AS total, greatest(count(*) FILTER (outcome = 'home'), count(*) FILTER (outcome = 'draw'), count(*) FILTER (outcome = 'away')) / count(*) AS purity FROM ({SCORED}) s, (SELECT unnest([2, 3, 4, 5]) AS n) x GROUP BY ALL HAVING count(*) >= 5),
      r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY purity DESC, total DESC, pattern) AS r FROM g)
      SELECT strategy, round(avg(purity) FILTER (r <= 20) * coalesce(sum(total) FILTER (r <= 20), 0) / sum(total) * ln(1 + count(*) FILTER (purity >= 0.7)), 6) AS score FROM r GROUP BY strategy ORDER BY score DESC, strategy LIMIT 1""",
    "ref_a29_bookmakers": "SELECT DISTINCT bookmaker_name FROM betting_odds",
    # sequences
    "ref_w01_previous_gap": "SELECT event_id, round(CAST(unix_seconds - lag(unix_seconds) OVER (PARTITION BY user_id ORDER BY unix_seconds, event_id) AS DOUBLE) / 3600, 6) AS gap_hours FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix_seconds FROM events) x",
    "ref_w02_change_runs": "SELECT user_id, count(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 END) - 1 AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) x GROUP BY user_id",
    "ref_w05_cycle_predictor": "SELECT id, CASE (row_number() OVER (PARTITION BY league_id ORDER BY id) - 1) % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS predicted FROM league_matches",
    "ref_w06_lag_predictor": f"SELECT id, coalesce(CASE lag(r) OVER (PARTITION BY league_id ORDER BY id) WHEN 'H' THEN 'D' WHEN 'D' THEN 'A' WHEN 'A' THEN 'H' END, r) AS predicted FROM (SELECT id, league_id, {HDA} AS r FROM league_matches) x",
    "ref_w07_pattern_rank": f"SELECT bookmaker, pattern, r FROM (SELECT bookmaker, pattern, row_number() OVER (PARTITION BY bookmaker ORDER BY purity DESC, total DESC, pattern) AS r FROM ({patterns('substring(code, 1, 4)', 3, 0.0)}) p) x WHERE r <= 20",
    "ref_w09_keep_last": f"SELECT id, match_id, final_score FROM {LATEST} l",
    # orders and limits (limits are the feature here)
    "ref_t01_latest_odds": "SELECT lm.match_id, bo.bookmaker_name, bo.id FROM league_matches lm JOIN betting_odds bo ON lm.match_id = bo.schedule_id ORDER BY lm.created_at DESC, bo.bookmaker_name, bo.id, lm.id LIMIT 100",
    "ref_t04_multi_key": f"SELECT bookmaker, pattern, total, round(purity, 6) AS purity FROM ({patterns('substring(code, 1, 4)', 3, 0.0)}) p ORDER BY p.purity DESC, total DESC, bookmaker, pattern LIMIT 20",
    "ref_t06_limit": "SELECT match_id, id FROM league_matches ORDER BY match_id, id LIMIT 100",
    "ref_t07_dynamic_order": "SELECT id, final_win FROM betting_odds WHERE final_win IS NOT NULL ORDER BY final_win DESC, id LIMIT 50",
    "ref_t10_numeric_order": "SELECT season, id FROM league_matches WHERE season IS NOT NULL ORDER BY CAST(substring(season, 1, 4) AS INT), id LIMIT 20",
    # sets
    "ref_u01_union_all": "SELECT id, schedule_id FROM betting_odds WHERE final_win BETWEEN 1.8 AND 2.0 UNION ALL SELECT id, schedule_id FROM betting_odds WHERE init_win BETWEEN 1.8 AND 2.0",
    "ref_u03_union": "SELECT bookmaker_name AS name FROM betting_odds UNION SELECT bookmaker FROM sax_encoding",
    "ref_u04_intersect": "SELECT match_id FROM sax_encoding WHERE bookmaker = 'Bet 365' INTERSECT SELECT match_id FROM sax_encoding WHERE bookmaker = 'Easybets'",
    "ref_u05_except": "SELECT match_id FROM league_matches EXCEPT SELECT match_id FROM total_handicap",
    # scalar functions
    "ref_r08_score_goals": "SELECT id, {0} AS home_goals, {1} AS away_goals FROM league_matches".format(*goals("final_score")),
    "ref_r09_labels": f"SELECT id, {OUTCOME} AS outcome, {HDA} AS hda, {result('final_score', ('胜', '平', '负'), 'NULL')} AS short FROM league_matches",
    "ref_r14_prefix": "SELECT id, substring(sax_interleaved, 1, 8) AS prefix, sax_interleaved || sax_delta AS code FROM sax_encoding",
    "ref_m01_implied": "SELECT id, round(CASE WHEN final_win > 0 THEN 1 / CAST(final_win AS DOUBLE) ELSE 0 END, 6) AS p FROM betting_odds",
    "ref_m02_margin_free": "SELECT id, round(CASE WHEN ok THEN (1 / h) / s ELSE 0 END, 6) AS p_home, round(CASE WHEN ok THEN (1 / d) / s ELSE 0 END, 6) AS p_draw, round(CASE WHEN ok THEN (1 / a) / s ELSE 0 END, 6) AS p_away, round(CASE WHEN ok THEN s END, 6) AS overround FROM (SELECT id, h, d, a, coalesce(h > 0 AND d > 0 AND a > 0, false) AS ok, 1 / nullif(h, 0) + 1 / nullif(d, 0) + 1 / nullif(a, 0) AS s FROM (SELECT id, CAST(final_win AS DOUBLE) AS h, CAST(final_draw AS DOUBLE) AS d, CAST(final_lose AS DOUBLE) AS a FROM betting_odds) x) y",
    "ref_m05_cover": "SELECT t.id, CASE WHEN h IS NULL OR a IS NULL OR v IS NULL THEN -1 WHEN h - a - v > 0 THEN 1 ELSE 0 END AS cover FROM (SELECT t.id, {0} AS h, {1} AS a, hl.line_value AS v FROM total_handicap t JOIN {2} l ON l.match_id = t.match_id LEFT JOIN handicap_lines hl ON hl.line_name = t.final_handicap) t".format(*goals("l.final_score"), LATEST),
    "ref_m12_support_threshold": f"SELECT bookmaker, pattern, total, CASE WHEN total >= 50 THEN 0.60 WHEN total >= 20 THEN 0.65 WHEN total >= 10 THEN 0.70 ELSE 0.75 END AS threshold FROM ({patterns('substring(code, 1, 2)', 1, 0.0)}) p",
    "ref_f16_predicate_text": "SELECT id, bookmaker_name, final_win FROM betting_odds WHERE bookmaker_name = 'Bet 365' AND final_win BETWEEN 1.5 AND 1.9 ORDER BY final_win DESC, id LIMIT 100",
    "ref_m03_two_way": "SELECT id, CASE WHEN h > 0 AND a > 0 THEN round(a / (h + a), 9) END AS p_home, CASE WHEN h > 0 AND a > 0 THEN round(h / (h + a), 9) END AS p_away FROM (SELECT id, CAST(final_win AS DOUBLE) AS h, CAST(final_lose AS DOUBLE) AS a FROM betting_odds) x",
    "ref_m06_rule_prediction": f"""WITH t AS (SELECT t.id, t.match_id, i.line_value AS iv, f.line_value AS fv, CAST(init_odds_home AS DOUBLE) AS a, CAST(final_odds_home AS DOUBLE) AS b FROM total_handicap t LEFT JOIN handicap_lines i ON i.line_name = t.handicap LEFT JOIN handicap_lines f ON f.line_name = t.final_handicap),
      rates AS (SELECT iv, avg(CASE WHEN o = 'home' THEN 1e0 ELSE 0e0 END) AS rate FROM t JOIN (SELECT match_id, {OUTCOME} AS o FROM {LATEST} l) m ON m.match_id = t.match_id WHERE o IS NOT NULL AND iv IS NOT NULL GROUP BY iv),
      j AS (SELECT t.id, coalesce(sign(fv - t.iv), 0) AS d, CASE WHEN a <> 0 AND b <> 0 THEN b - a ELSE 0 END AS w, rate FROM t LEFT JOIN rates ON rates.iv = t.iv)
      SELECT id, CASE WHEN d > 0 OR (d = 0 AND (w < -0.1 OR (w <= 0.1 AND coalesce(rate > 0.45, false)))) THEN '主胜' ELSE '主队不胜' END AS prediction,
        coalesce(nullif(concat_ws(', ', CASE WHEN d > 0 THEN '升盘' WHEN d < 0 THEN '降盘' END, CASE WHEN w < -0.1 THEN '降水' WHEN w > 0.1 THEN '升水' END, CASE WHEN rate IS NOT NULL THEN '相似比赛主胜率' || CAST(CAST(round(rate * 100, 0) AS INT) AS VARCHAR) || '%' END), ''), '无明显特征') AS reasons FROM j""",
    "ref_x23_truncated_match": f"""WITH e AS ({SCORED}), l4 AS ({patterns('left(code, 4)', 5, 0.5)}), l3 AS ({patterns('left(code, 3)', 5, 0.5)}), l2 AS ({patterns('left(code, 2)', 5, 0.5)})
      SELECT e.id, coalesce(l4.dominant, l3.dominant, l2.dominant) AS prediction, CASE WHEN l4.pattern IS NOT NULL THEN 4 WHEN l3.pattern IS NOT NULL THEN 3 WHEN l2.pattern IS NOT NULL THEN 2 END AS letters
      FROM e LEFT JOIN l4 ON l4.bookmaker = e.bookmaker AND l4.pattern = left(e.code, 4) LEFT JOIN l3 ON l3.bookmaker = e.bookmaker AND l3.pattern = left(e.code, 3) LEFT JOIN l2 ON l2.bookmaker = e.bookmaker AND l2.pattern = left(e.code, 2)""",
    "ref_x24_majority_vote": f"""WITH lib AS ({patterns('left(code, 3)', 5, 0.45)}), said AS (SELECT e.match_id, e.bookmaker, min(lib.dominant) AS says FROM ({SCORED}) e JOIN lib ON lib.bookmaker = e.bookmaker AND lib.pattern = left(e.code, 3) GROUP BY 1, 2),
      votes AS (SELECT match_id, says, count(*) AS votes FROM said GROUP BY 1, 2)
      SELECT match_id, says AS prediction, votes FROM votes WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY votes DESC, CASE says WHEN 'home' THEN 0 WHEN 'draw' THEN 1 ELSE 2 END) = 1""",
}
