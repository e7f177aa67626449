"""Chunks of answers, translated event by event in their order, though they come out of order.

A stream's chunks count from 0. State holds the number of the next chunk and those that came too early. Each micro-batch
gives the events of all chunks that have their turn; chunks that came before are dropped. A stream's state goes
when it has been idle: then what is still waiting is given in order, over the gap. Chunks after the last event are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.functions.dialects import chunk_events, stream_events

STOP = "event: message_stop"
#: The turn of a stream whose last event was given.
OVER = 1 << 62


def chunk_rows(chunks: DataFrame, stream_col: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(stream_id, seq, n, event) of a table of chunks: the first of a stream opens the message. n counts a chunk's events."""
    first = F.row_number().over(Window.partitionBy(stream_col).orderBy(seq)) == 1
    rows = chunks.withColumn("_first", first)
    events = F.posexplode(stream_events(F.col(chunk), F.col("_first")))
    return rows.select(F.col(stream_col).alias("stream_id"), F.col(seq).cast("long").alias("seq"), events.alias("n", "event"))


def chunk_stream(stream: DataFrame, ts: str, stream_col: str = "stream_id", seq: str = "seq", chunk: str = "chunk", late: str = "10 minutes", idle: int = 600) -> DataFrame:
    """The same rows from a stream of chunks. idle: seconds of event time after which a stream is given up."""
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(ts, late).select(F.col(ts), F.col(stream_col).alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk"), (F.unix_micros(F.col(ts)) / 1000).cast("long").alias("ms"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, seen, seqs, texts = state.get if state.exists else (0, 0, [], [])
        waiting = dict(zip(seqs, texts, strict=True))
        out: list[tuple[int, int, str]] = []
        idle_now = state.hasTimedOut
        if not idle_now:
            for f in frames:
                seen = max(seen, int(f["ms"].max()))
                for s, text in zip(f["seq"].tolist(), f["chunk"].tolist(), strict=True):
                    if s >= turn:
                        waiting.setdefault(s, text)
        begun = turn > 0
        for s in sorted(waiting):
            if s != turn and not idle_now:
                break
            text = waiting.pop(s)
            events = [] if text is None else chunk_events(text, not begun) or []
            begun, turn = True, s + 1
            out += [(s, n, e) for n, e in enumerate(events)]
            if any(e.startswith(STOP) for e in events):
                turn, waiting = OVER, {}
                break
        if out:
            yield pd.DataFrame({"stream_id": [k[0]] * len(out), "seq": [s for s, _, _ in out], "n": [n for _, n, _ in out], "event": [e for _, _, e in out]})
        if idle_now:
            state.remove()
            return
        state.update((turn, seen, list(waiting), list(waiting.values())))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, seen + idle * 1000))

    held = "turn bigint, seen bigint, seqs array<bigint>, texts array<string>"
    return rows.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kinds[stream_col]}, seq bigint, n int, event string", held, "append", GroupStateTimeout.EventTimeTimeout)
