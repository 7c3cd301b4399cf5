"""Result events of review cells as a stream: the state of each cell decides every event's outcome.

The outcomes are those of ``folioquery.operators.review.ingest``, for events that
arrive in order of ``seq`` within a cell over the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioquery.operators.review import ATTEMPTS

STATE = "invalid int, accepted string"


def decide(invalid: int, accepted: str | None, payload: str, valid: bool, stale: bool) -> tuple[str, int, str | None]:
    """Outcome of one event with the state after it."""
    if stale:
        return "stale", invalid, accepted
    if accepted is not None:
        return ("repeat" if payload == accepted else "conflict"), invalid, accepted
    if invalid >= ATTEMPTS:
        return "closed", invalid + (not valid), accepted
    if valid:
        return "accepted", invalid, payload
    return ("failed" if invalid == ATTEMPTS - 1 else "invalid"), invalid + 1, accepted


def _cell(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    invalid, accepted = state.get if state.exists else (0, None)
    events = pd.concat(list(batches)).sort_values("seq")
    out = []
    for e in events.itertuples():
        outcome, invalid, accepted = decide(invalid, accepted, e.payload, bool(e.valid), bool(e.stale))
        out.append((key[0], e.seq, outcome))
    state.update((invalid, accepted))
    yield pd.DataFrame(out, columns=["cell_id", "seq", "outcome"])


def ingest_stream(events: DataFrame) -> DataFrame:
    """(cell_id, seq, outcome) of a stream of (cell_id, seq, payload, valid, stale); one micro-batch of a cell is held at a time."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"cell_id {kind['cell_id']}, seq {kind['seq']}, outcome string"
    return events.groupBy("cell_id").applyInPandasWithState(_cell, schema, STATE, "append", GroupStateTimeout.NoTimeout)
