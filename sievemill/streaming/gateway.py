"""Structured Streaming forms of the engine: the same columns on streams, and keyed state for budgets and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.functions import noise, redaction
from sievemill.operators.traffic import HOUR, TTL, admit


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Secrets masked, noise pruned; no state."""
    masked = redaction.redact(F.col(text_col))
    return stream.withColumn("clean", noise.pruned(masked)["kept"])


def windowed_counters(stream: DataFrame, ts: str = "ts", span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Totals by window of event time; rows later than the watermark are dropped. Needs raw and clean byte counts."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, span)).agg(F.count("*").alias("requests"), F.sum("raw").alias("raw"), F.sum("clean").alias("clean"))


def breaker_stream(stream: DataFrame, key: str, limit: int | None, span: int = HOUR) -> DataFrame:
    """Admission by rolling budget. stream: key, id, at (seconds as double), tokens. Within a micro-batch a key's requests
    go in order of (at, id); the state of a key is its admitted requests of the last hour."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        held = list(zip(*state.get, strict=True)) if state.exists else []
        ok, held = admit(rows["at"].to_numpy(), rows["tokens"].to_numpy(), limit, span, held)
        state.update(([a for a, _ in held], [int(t) for _, t in held]))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "id": rows["id"].to_numpy(), "tokens": rows["tokens"].to_numpy(), "admitted": ok})

    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), "id", "at", "tokens")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds[key]}, id {kinds['id']}, tokens bigint, admitted boolean", "at array<double>, tokens array<bigint>", "append", GroupStateTimeout.NoTimeout)


def cache_stream(stream: DataFrame, key: str, seconds: int = TTL) -> DataFrame:
    """Hits of a response cache per key. stream: key, id, at (seconds). A miss stores, a hit doesn't renew."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        stored = state.get[0] if state.exists else float("-inf")
        hits = []
        for at in rows["at"]:
            hits.append(at - stored < seconds)
            stored = stored if hits[-1] else at
        state.update((float(stored),))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "id": rows["id"].to_numpy(), "hit": hits})

    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), "id", "at")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds[key]}, id {kinds['id']}, hit boolean", "stored double", "append", GroupStateTimeout.NoTimeout)
