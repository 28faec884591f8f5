"""Keyed state on streams: how far each case has come, and how often it went back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.streaming.progress import STAGES

OUTPUT = "user_id long, furthest string, steps_back long, n long"
_STATE = "furthest int, steps_back long, n long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    furthest, back, n = state.get if state.exists else (-1, 0, 0)
    rows = pd.concat([b[["ts", "event_id", "stage"]] for b in batches]).sort_values(["ts", "event_id"])
    reached = rows["stage"].cummax().clip(lower=furthest)
    back += int((rows["stage"] < reached).sum())
    furthest, n = int(reached.iloc[-1]), n + len(rows)
    state.update((furthest, back, n))
    yield pd.DataFrame({"user_id": [key[0]], "furthest": [STAGES[furthest]], "steps_back": [back], "n": [n]})


def stage_progress(events: DataFrame) -> DataFrame:
    """Per user (user_id, furthest, steps_back, n): the furthest stage so far, and how many events came after one of a later stage.

    A stream in update mode; state is three numbers a user. Events of a trigger are taken by ts and event_id, triggers in the order they come;
    rows of other kinds than STAGES don't count.
    """
    stage = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("event_type")).cast("int") - 1
    known = events.select("user_id", "ts", "event_id", stage.alias("stage")).where("stage >= 0")
    return known.groupBy("user_id").applyInPandasWithState(_advance, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)
