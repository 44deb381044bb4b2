"""The nested layouts of match_odds.payload and total_handicap.odds_detail, as tables for ``operators.nested``."""

from tidegrid.operators.nested import Level, NestedTable, Way

#: Bookmaker entries: an array, an object of entries by number, or the flat layout where the record is the only entry.
_ENTRY = (
    Way(("bookmakers", "*"), array=False),
    Way((), array=False, without="bookmakers", having=("bookmakerName", "runningOdds")),
    Way(("*",), array=True),
)
_READING = (Way(("runningOdds", "*")),)
#: odds_detail is an array of readings, or an object that wraps it.
_DETAIL = (Way(("*",), array=True), Way(("*", "*"), array=False))

RECORDS = NestedTable((Level(None, (Way((), array=False),), (("schedule_text", ("scheduleId",)), ("home_name", ("hometeam",)), ("guest_name", ("guestteam",)))),))
ENTRIES = NestedTable(
    (
        Level(
            "entry_no",
            _ENTRY,
            (
                ("bookmaker", ("bookmakerName",)), ("bookmaker_id", ("bookmakerId",)), ("internal_id", ("internalId",)),
                ("init_home", ("initialOdds", "home")), ("init_draw", ("initialOdds", "draw")), ("init_away", ("initialOdds", "away")),
                ("final_home", ("finalOdds", "home")), ("final_draw", ("finalOdds", "draw")), ("final_away", ("finalOdds", "away")),
            ),
            (("n_readings", _READING),),
        ),
    )
)
ENTRY_COUNTS = NestedTable((Level("entry_no", _ENTRY, (("bookmaker", ("bookmakerName",)),), (("n_readings", _READING),)),))
READINGS = NestedTable(
    (
        Level("entry_no", _ENTRY, (("bookmaker", ("bookmakerName",)),)),
        Level(
            "seq",
            _READING,
            (
                ("home", ("home",)), ("draw", ("draw",)), ("away", ("away",)), ("time", ("time",)), ("year", ("year",)),
                ("return_home", ("returnRate", "home")), ("return_draw", ("returnRate", "draw")), ("return_away", ("returnRate", "away")),
            ),
        ),
    )
)
READING_TIMES = NestedTable((Level("entry_no", _ENTRY, (("bookmaker", ("bookmakerName",)),)), Level("seq", _READING, (("time", ("time",)), ("year", ("year",))))))
READING_PRICES = NestedTable(
    (Level("entry_no", _ENTRY, (("bookmaker", ("bookmakerName",)),)), Level("seq", _READING, (("home", ("home",)), ("draw", ("draw",)), ("away", ("away",)), ("time", ("time",)), ("year", ("year",)))))
)
DETAIL_COUNTS = NestedTable((Level(None, (Way(()),), (), (("n_readings", _DETAIL),)),))
DETAIL_READINGS = NestedTable((Level("seq", _DETAIL, (("line_text", ("handicap",)), ("home", ("home",)), ("away", ("away",)), ("time", ("time",)))),))
DETAIL_TIMES = NestedTable((Level("seq", _DETAIL, (("time", ("time",)),)),))
