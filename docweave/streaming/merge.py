"""The per-document state as a stream: observations in any number of micro-batches, merged in order of visit.

Within a batch a document's observations are folded in order of visit; state is kept between batches. With
observations that arrive in order this equals operators.state.merge_scalars() on the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "document_id long, key string, value string, source_visit long, confidence double, revisions long"
STATE = "value string, norm string, source_visit long, confidence double, revisions long"


def fold(state: tuple | None, rows) -> tuple | None:
    """rows: (visit, value, norm, confidence) in order; state: (value, norm, visit, confidence, revisions)."""
    for visit, value, norm, confidence in rows:
        if not value:
            continue
        if state is None:
            state = (value, norm, visit, confidence, 0)
        elif confidence > state[3]:
            state = (*state[:3], confidence, state[4]) if norm == state[1] else (value, norm, visit, confidence, state[4] + 1)
    return state


def merge_stream(observations: DataFrame) -> DataFrame:
    """observations (document_id, key, visit, value, norm, confidence) as a stream of updates, the newest state of each changed field."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("visit", kind="stable")
        now = fold(state.get if state.exists else None, rows[["visit", "value", "norm", "confidence"]].itertuples(index=False, name=None))
        if now is not None:
            state.update(now)
            yield pd.DataFrame([(*key, now[0], now[2], now[3], now[4])], columns=["document_id", "key", "value", "source_visit", "confidence", "revisions"])

    return observations.groupBy("document_id", "key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """One row a field out of all updates: the one with the highest confidence, the last state."""
    from pyspark.sql import functions as F

    best = updates.groupBy("document_id", "key").agg(F.max_by(F.struct("value", "source_visit", "confidence", "revisions"), F.struct("confidence", "revisions", "source_visit")).alias("s"))
    return best.select("document_id", "key", "s.*")


def dedupe_stream(rows: DataFrame, key: list[str], time: str, lateness: str) -> DataFrame:
    """First row of each key within the watermark, for overlapping windows that repeat rows."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)
