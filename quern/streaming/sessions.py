"""Streams with state: sessions, sliding counts, answers awaited. Extensions: the content site has no streams.

``time`` is a column of type TIMESTAMP. A watermark follows the latest time seen, ``late``
behind it; state for what lies before it is let go, and rows that come later still are dropped.
In append mode a session or a window is written once, when the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, end, n): rows of the same keys, none further than ``gap`` from the next one; end is the last row's time and the gap. Null times belong to no session, null keys are a key."""
    w = F.session_window(time, gap)
    found = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(stream: DataFrame, time: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, end, n): rows in windows of that width, one beginning every step; a row counts in each window that holds it."""
    w = F.window(time, width, step)
    found = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each key once, over all batches, as long as its repeats come within ``late`` of the first one. State is kept for so long only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


_ANSWERS = "conv_id long, turn long, asked timestamp, answered timestamp"
_STATE = "turn long, asked timestamp"


def answers(stream: DataFrame, late: str, patience_ms: int) -> DataFrame:
    """(conv_id, turn, asked, answered) for each question of a transcript (conv_id, turn, role, time).

    A question is a turn of role user; its answer is the next turn of another role, in this
    batch or a later one. A question after an open question replaces it, and the open one is
    written unanswered; so is one that has waited ``patience_ms`` when the watermark gets
    there. Within a batch turns count in their order. Null times are passed over.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        turn, asked = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], turn, asked, None))
            state.remove()
        else:
            for r in pd.concat(batches).sort_values("turn").itertuples():
                if r.role == "user":
                    if turn is not None:
                        out.append((key[0], turn, asked, None))
                    turn, asked = r.turn, r.time.to_pydatetime()
                elif turn is not None:
                    out.append((key[0], turn, asked, r.time))
                    turn = asked = None
            if turn is not None:
                state.update((int(turn), asked))
                due = int(pd.Timestamp(asked).timestamp() * 1000) + patience_ms
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["conv_id", "turn", "asked", "answered"]).astype({"asked": "datetime64[ns]", "answered": "datetime64[ns]"})

    rows = stream.filter("time IS NOT NULL").withWatermark("time", late)
    return rows.groupBy("conv_id").applyInPandasWithState(follow, _ANSWERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def written(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what the stream gives to a Parquet table until all that is there has been read. The file sink writes each batch once, also after a restart."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
