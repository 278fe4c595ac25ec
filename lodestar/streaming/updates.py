"""The log of changes and reviews as a stream: the state of each judgment, kept between micro-batches.

State holds counts and the open suggestions of a judgment, a handful of texts, never its events.  Each micro-batch
writes the judgments that it touched to a keyed table; a batch that is run again after a failure writes the same
rows again, so the table is what the whole log makes of it (``evidence.reviewed_log``), once the stream caught up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.evidence import DECISIONS
from lodestar.sources.versions import KeyedTable

KEYS = ("node_id", "entry")
STATE = "n_events long, n_reviewed long, told boolean, suggestions array<string>"
OUT = "node_id string, entry string, n_events long, n_reviewed long, status string, suggestions string"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A judgment after the rows of a micro-batch, in their order."""
    n_events, n_reviewed, told, open_ = state.get if state.exists else (0, 0, False, [])
    open_ = set(open_)
    rows = [r for batch in batches for r in batch.itertuples(index=False)]
    for r in sorted(rows, key=lambda r: r.seq):
        if r.decision is None:
            told = True
            if r.affected:
                n_events += 1
                open_ |= set(r.suggestions if r.suggestions is not None else ())
        elif r.decision in DECISIONS and (r.note or "").strip(" "):
            n_reviewed, open_ = n_events, set()
    state.update((n_events, n_reviewed, told, sorted(open_)))
    if told:
        status = "unchanged" if not n_events else "pending" if n_reviewed < n_events else "resolved"
        yield pd.DataFrame([(*key, n_events, n_reviewed, status, "; ".join(sorted(open_)))], columns=["node_id", "entry", "n_events", "n_reviewed", "status", "suggestions"])


def follow(log: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Start to keep ``table`` at what the streamed ``log`` (``node_id, entry`` and ``evidence.LOG``) makes of each judgment; stops when it caught up.

    ``seq`` must not fall back from one micro-batch to the next within a judgment.
    """
    kept = log.groupBy(*KEYS).applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
    write = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda rows, _: table.merge(rows.persist()) and None).start()
