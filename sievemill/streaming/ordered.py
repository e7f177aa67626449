"""Streams whose rows come out of order, with state that goes when nobody needs it any more.

Rows wait until the watermark has passed them; what a key's rows give is then decided in the order of (time, id), so the
result is that of the batch operators however rows were cut into micro-batches, as long as they come before the watermark
does (later ones are dropped, as everywhere in Structured Streaming). Event-time timers wake a key when its next waiting row is
due, and once more when what it holds can't matter to any later row: its state is then removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.operators.traffic import HOUR, TTL, admit

#: Takes a key's due rows in order and what it holds, and gives the results, what it holds now, and until when (in us).
Step = Callable[[pd.DataFrame, list], tuple[list, list, int]]


def in_order(stream: DataFrame, key: str, ts: str, order: str, value: str | None, late: str, step: Step, out: str) -> DataFrame:
    """(key, id, value, result) of a step over each key's rows in order. Held entries are pairs (time in us, number)."""
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(ts, late).select(F.col(ts), F.col(key).alias("key"), F.col(order).alias("id"), F.unix_micros(F.col(ts)).alias("at"), (F.col(value) if value else F.lit(0)).cast("long").alias("value"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait_at, wait_id, wait_value, held_at, held_value = state.get if state.exists else ([], [], [], [], [])
        waiting = pd.DataFrame({"at": list(wait_at), "id": list(wait_id), "value": list(wait_value)})
        new = [f[["at", "id", "value"]] for f in frames] if not state.hasTimedOut else []
        waiting = pd.concat([f for f in [waiting, *new] if len(f)] or [waiting], ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        due = waiting[waiting["at"] <= mark * 1000]
        held = list(zip(held_at, held_value, strict=True))
        if len(due):
            results, held, _ = step(due, held)
            yield pd.DataFrame({"key": [k[0]] * len(due), "id": due["id"].to_numpy(), "value": due["value"].to_numpy(), "result": results})
        left = waiting.iloc[len(due) :]
        until = step(due.iloc[:0], held)[2]
        if len(left) or until > mark * 1000:
            state.update((left["at"].astype("int64").tolist(), left["id"].tolist(), left["value"].astype("int64").tolist(), [int(a) for a, _ in held], [int(n) for _, n in held]))
            next_ = int(left["at"].iloc[0]) if len(left) else until
            state.setTimeoutTimestamp(max(mark + 1, -(-next_ // 1000)))
        elif state.exists:
            state.remove()

    held = f"wait_at array<bigint>, wait_id array<{kinds[order]}>, wait_value array<bigint>, held_at array<bigint>, held_value array<bigint>"
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds[key]}, id {kinds[order]}, value bigint, result {out}", held, "append", GroupStateTimeout.EventTimeTimeout)


def breaker_in_order(stream: DataFrame, key: str, ts: str, order: str, tokens: str, limit: int | None, span: int = HOUR, late: str = "10 minutes") -> DataFrame:
    """(key, id, tokens, admitted), as ``traffic.breaker`` gives them; a key's state goes ``span`` after what it admitted last."""

    def step(due: pd.DataFrame, held: list) -> tuple[list, list, int]:
        ok, held = admit(due["at"].to_numpy(), due["value"].to_numpy(), limit, span * 1_000_000, held)
        return ok.tolist(), held, held[-1][0] + span * 1_000_000 if held else 0

    return in_order(stream, key, ts, order, tokens, late, step, "boolean").select("key", "id", F.col("value").alias("tokens"), F.col("result").alias("admitted"))


def cache_in_order(stream: DataFrame, key: str, ts: str, order: str, seconds: int = TTL, late: str = "10 minutes") -> DataFrame:
    """(key, id, hit), as ``traffic.response_cache`` gives them; an answer's state goes when it has expired."""
    span = seconds * 1_000_000

    def step(due: pd.DataFrame, held: list) -> tuple[list, list, int]:
        hits = []
        for at in due["at"]:
            hits.append(bool(held) and at - held[0][0] < span)
            held = held if hits[-1] else [(int(at), 0)]
        return hits, held, held[0][0] + span if held else 0

    return in_order(stream, key, ts, order, None, late, step, "boolean").select("key", "id", F.col("result").alias("hit"))
