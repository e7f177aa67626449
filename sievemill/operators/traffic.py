"""Economics of a text gateway over its request log: counters, budgets, response cache, routing checks.

Time is a column of the log, not the clock. Budgets and caches depend on what was decided before, so they are folds over
each key's requests in order (ts, then id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.ordered import dealt, prefix_sum
from sievemill.operators.skew import join_unique
from sievemill.sources.scratch import written

HOUR, TTL, MOST_ENTRIES = 3600, 300, 1000
PRICE = 3.0
# Headers that a proxy doesn't pass on; loopback names.
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers", "transfer-encoding", "upgrade", "host", "content-length")
LOOPBACK = ("localhost", "127.0.0.1", "::1", "[::1]")
MAX_BODY, MAX_HEADER, MAX_HEADERS = 32 << 20, 64 << 10, 100


def counters(log: DataFrame, *by: str) -> DataFrame:
    """Totals. log: ts, raw, clean, secrets, cache_tokens (null: no hit), limited, tripped, latency_ms."""
    return log.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("raw").alias("raw"), F.sum("clean").alias("clean"), F.sum("secrets").alias("secrets"),
        F.count("cache_tokens").alias("cache_hits"), F.coalesce(F.sum("cache_tokens"), F.lit(0)).alias("cache_tokens"),
        F.sum(F.col("limited").cast("long")).alias("rate_limits"), F.sum(F.col("tripped").cast("long")).alias("trips"), F.max_by("latency_ms", "ts").alias("last_latency_ms"),
    )


def report(totals: DataFrame) -> DataFrame:
    """Savings from counters."""
    less = F.greatest(F.floor(F.col("raw") / 4) - F.floor(F.col("clean") / 4), F.lit(0)).cast("long")
    rows = totals.withColumns({"raw_tokens": F.floor(F.col("raw") / 4).cast("long"), "clean_tokens": F.floor(F.col("clean") / 4).cast("long"), "saved_by_surgery": less, "tokens_saved": less + F.col("cache_tokens")})
    pct = F.when(F.col("raw") > 0, F.round(F.greatest(F.col("raw") - F.col("clean"), F.lit(0)) / F.col("raw") * 100.0, 1)).otherwise(0.0)
    return rows.withColumns({"reduction_pct": pct, "cost_saved": F.round(F.col("tokens_saved") / 1e6 * PRICE, 3)})


def bar(raw: Column, clean: Column) -> Column:
    """Width of a chart's bar in per cent."""
    return F.greatest(F.lit(5.0), F.when(raw > 0, clean / raw * 100.0).otherwise(0.0))


def rolling_sum(log: DataFrame, key: str, ts: str, tokens: str, seconds: int = HOUR) -> DataFrame:
    """log with the sum of tokens of the key's requests of the last hour, its start and the request itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    over = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("hourly_tokens", F.sum(tokens).over(over).cast("long"))


def rolling_total(log: DataFrame, ts: str, tokens: str, key: str | None = None, seconds: int = HOUR) -> DataFrame:
    """log with hourly_tokens as ``rolling_sum`` gives them, for one budget that all share, or for keys of any size.

    A sum over the last hour is the difference of two prefix sums: up to the request's time, and before an hour earlier.
    Both are asked for as points of one order, which is cut into ranges, so that no key is one task's work. Requests of
    one time are added up first. Requests without a time or a key are left with null."""
    whose = F.lit("all") if key is None else F.col(key).cast("string")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = log.withColumns({"_whose": whose, "_at": at})
    per = written(rows.filter("_whose is not null and _at is not null").groupBy("_whose", "_at").agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n"), F.count("*").alias("requests")), "times")
    point = lambda when, n, kind: F.struct(when.cast("long").alias("when"), n.cast("long").alias("n"), F.lit(kind).alias("kind"))
    both = F.array(point(F.col("_at") - seconds * 1_000_000, F.lit(0), 0), point(F.col("_at"), F.col("n"), 1))
    points = per.select("_whose", "_at", F.explode(both).alias("p")).select("_whose", "_at", "p.*")
    sums = prefix_sum(points, [F.col("_whose"), F.col("when"), F.col("kind")], F.col("n"), "before")
    upto = F.sum(F.when(F.col("kind") == 1, F.col("before") + F.col("n")).otherwise(-F.col("before")))
    known = sums.groupBy("_whose", "_at").agg(upto.cast("long").alias("hourly_tokens")).join(per.select("_whose", "_at", "requests"), ["_whose", "_at"])
    total = per.agg(F.sum("requests")).first()[0] or 0
    met = join_unique(rows, known, ["_whose", "_at"], "requests", total)
    timeless = rows.filter("_whose is null or _at is null").withColumn("hourly_tokens", F.lit(None).cast("long"))
    return met.unionByName(timeless).drop("_whose", "_at")


def admit(at: np.ndarray, tokens: np.ndarray, limit: int | None, span: float = HOUR, history: list | None = None) -> tuple[np.ndarray, list]:
    """(admitted, history): a request is admitted if the admitted tokens of the last hour and its own are within the limit.
    What isn't admitted isn't recorded. history: (second, tokens) that still count, in order."""
    held = list(history or [])
    total, start = sum(t for _, t in held), 0
    out = np.ones(len(at), bool)
    for i, (now, n) in enumerate(zip(at.tolist(), tokens.tolist(), strict=True)):
        while start < len(held) and now - held[start][0] > span:
            total -= held[start][1]
            start += 1
        if limit and total + n > limit:
            out[i] = False
            continue
        held.append((now, n))
        total += n
    return out, held[start:]


def breaker(log: DataFrame, key: str, ts: str, order: str, tokens: str, limit: int | None) -> DataFrame:
    """(key, order, tokens, admitted). A key's requests go through one task in order, batch after batch; only the last
    hour's are held."""
    rows = log.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"), F.col(tokens).cast("long").alias("tokens"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "order")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, history = object(), []
        for batch in batches:
            parts = []
            for key_, group in batch.groupby("key", sort=False, dropna=False):
                if key_ != now:
                    now, history = key_, []
                ok, history = admit(group["at"].to_numpy() / 1e6, group["tokens"].to_numpy(), limit, history=history)
                parts.append(ok)
            yield pd.DataFrame({"key": batch["key"], "order": batch["order"], "tokens": batch["tokens"], "admitted": np.concatenate(parts) if parts else np.empty(0, bool)})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(fold, f"key {kinds['key']}, `order` {kinds['order']}, tokens bigint, admitted boolean")


def cache_key(url: Column, body: Column) -> Column:
    return F.sha2(F.concat(url, F.lit(":"), body), 256)


def cacheable(method: Column, path: Column, streamed: Column, no_cache: Column, suffixes: tuple[str, ...] = ("/chat/completions", "/messages", "/completions", "/generate")) -> Column:
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | path.endswith(s)
    return (method == "POST") & ~streamed & ~no_cache & ends


def response_cache(log: DataFrame, key: str, ts: str, order: str, seconds: int = TTL) -> DataFrame:
    """(key, order, hit): whether the key's stored answer is younger than ``seconds``. A miss stores, a hit doesn't renew.

    A key's requests go through one task in order, batch after batch; only the last store time is held."""
    rows = log.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "order")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stored = object(), 0
        for batch in batches:
            hits = []
            for k, at in zip(batch["key"], batch["at"], strict=True):
                hit = k == now and at - stored < seconds * 1_000_000
                if not hit:
                    now, stored = k, at
                hits.append(hit)
            yield pd.DataFrame({"key": batch["key"], "order": batch["order"], "hit": hits})

    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(fold, f"key {kinds['key']}, `order` {kinds['order']}, hit boolean")
    return out.select(F.col("key").alias(key), F.col("order").alias(order), "hit")


def shared_cache(requests: pd.DataFrame, seconds: int = TTL, most: int = MOST_ENTRIES) -> np.ndarray:
    """Hits of one cache that all keys share: it is emptied when it holds ``most`` entries and another is to be stored.
    requests (key, at) in order; this is one sequence by nature, for a single gateway's log."""
    return shared_run(list(requests["key"]), list(requests["at"]), {}, seconds, most)[0]


#: Requests that are replayed in one go.
REPLAYED = 50_000


def shared_hits(log: DataFrame, key: str, ts: str, order: str, seconds: int = TTL, most: int = MOST_ENTRIES, replayed: int = REPLAYED) -> DataFrame:
    """(key, order, hit) of one cache that all keys share, as ``shared_cache`` gives them, over a log of any size.

    The log is cut into ranges of time, which are replayed at the same time, each from a guessed state (what the range
    before it left, at first from an empty cache). The states that ranges leave are then handed on; only ranges whose start
    was guessed wrongly are replayed again, until all starts are what came before. A cache that was emptied within a range
    at the same request leaves the same state whatever it started from, so few rounds are the rule; a log whose ranges all
    depend on each other takes as many rounds as there are ranges, and is right nevertheless. A state has ``most`` entries
    at most; a task holds one range. Requests go in order of (ts, order), which should be unique."""
    rows = log.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"))
    ranges = dealt(rows, [F.col("at"), F.col("order")], "range", max(1, -(-log.count() // replayed)))
    rows = ranges.withColumn("part", F.element_at(F.lit(joined_ranges(ranges, replayed)), F.col("range") + 1))
    kinds = dict(rows.dtypes)
    state = f"keys array<{kinds['key']}>, ats array<bigint>"
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
    spark = rows.sparkSession

    def replay(found: pd.DataFrame, start: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, dict]:
        found = found.sort_values(["at", "order"], kind="stable", ignore_index=True)
        stored = dict(zip(start["keys"].iloc[0], start["ats"].iloc[0], strict=True)) if len(start) and start["keys"].iloc[0] is not None else {}
        return found, *shared_run(found["key"].tolist(), found["at"].tolist(), stored, seconds * 1_000_000, most)

    def left(found: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return pd.DataFrame({"part": [], "keys": [], "ats": []})
        entries = sorted(replay(found, start)[2].items(), key=lambda e: (e[1], str(e[0])))
        return pd.DataFrame({"part": [found["part"].iloc[0]], "keys": [[k for k, _ in entries]], "ats": [[a for _, a in entries]]})

    def hits(found: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return pd.DataFrame({"key": [], "order": [], "hit": []})
        found, hit, _ = replay(found, start)
        return pd.DataFrame({"key": found["key"], "order": found["order"], "hit": hit})

    def met(which: list[int], starts: DataFrame, run, schema: str) -> DataFrame:
        mine = F.col("part").isin(which)
        return rows.filter(mine).groupBy("part").cogroup(starts.filter(mine).groupBy("part")).applyInPandas(run, schema)

    nothing = spark.createDataFrame([], f"part int, {state}")
    ends = written(met(parts, nothing, left, f"part int, {state}"), "states") if parts else nothing
    starts = nothing
    place = F.struct("keys", "ats")
    while True:
        handed = ends.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "keys", "ats").filter("part is not null")
        old = starts.select("part", place.alias("old"))
        changed = sorted(r["part"] for r in handed.join(old, "part", "left").filter(~place.eqNullSafe(F.col("old")) & ((F.size("keys") > 0) | F.col("old").isNotNull())).select("part").collect())
        if not changed:
            break
        starts = written(handed, "starts")
        again = met(changed, starts, left, f"part int, {state}")
        ends = written(ends.filter(~F.col("part").isin(changed)).unionByName(again), "states")
    out = met(parts, starts, hits, f"key {kinds['key']}, `order` {kinds['order']}, hit boolean") if parts else spark.createDataFrame([], f"key {kinds['key']}, `order` {kinds['order']}, hit boolean")
    return out.select(F.col("key").alias(key), F.col("order").alias(order), "hit")


def joined_ranges(ranges: DataFrame, replayed: int) -> np.ndarray:
    """Which part each range goes to: ranges that are small next to each other are replayed as one."""
    sizes = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}
    size = np.array([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])
    return ((np.cumsum(size) - size) // replayed).astype(np.int32)


def shared_run(keys: list, at: list, stored: dict, span: float, most: int) -> tuple[np.ndarray, dict]:
    """(hits, what is stored in the end) of one cache that starts with what is stored."""
    out = np.zeros(len(keys), bool)
    for i, (k, now) in enumerate(zip(keys, at, strict=True)):
        if k in stored and now - stored[k] < span:
            out[i] = True
            continue
        if len(stored) >= most:
            stored.clear()
        stored[k] = now
    return out, stored


def estimated(request: Column, response: Column) -> Column:
    return F.floor((F.octet_length(request) + F.octet_length(response)) / 4).cast("long")


def retry_wait(attempt: Column, retry_after: Column, most: int = 3) -> Column:
    """Seconds to wait after a 429, null when no attempt is left."""
    return F.when(attempt < most, F.least(F.coalesce(retry_after, F.least(F.pow(F.lit(2), attempt), F.lit(20)).cast("long")), F.lit(30)).cast("long"))


def bare_path(path: Column) -> Column:
    """Without query and last slashes; the root stays."""
    out = F.regexp_replace(F.regexp_extract(path, r"\A([^?]*)", 1), r"/+\z", "")
    return F.when(out == "", "/").otherwise(out)


def passed_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*HOP_BY_HOP))


def host_of(address: Column) -> Column:
    """Host of host, host:port, [v6] or [v6]:port, brackets off."""
    a = F.trim(address)
    return F.when(a.startswith("["), F.regexp_extract(a, r"\A\[([^\]]*)", 1)).when(a.rlike(r":.*:"), a).otherwise(F.regexp_extract(a, r"\A([^:]*)", 1))


def is_loopback(address: Column) -> Column:
    host = host_of(address)
    return F.trim(address).isin(*LOOPBACK) | host.isin("localhost", "::1") | host.rlike(r"\A127\.(?:\d{1,3})\.(?:\d{1,3})\.(?:\d{1,3})\z")


def allowed_host(host_header: Column, bind: Column) -> Column:
    host = host_of(host_header)
    return host.isin("localhost", "127.0.0.1", "::1") | (host == F.regexp_replace(F.regexp_replace(bind, r":[^:]*\z", ""), r"[\[\]]", ""))


def token_matches(given: Column, wanted: str | None) -> Column:
    """Whether 'Bearer x' or x is the wanted token; without one everything passes."""
    return F.lit(True) if not wanted else F.coalesce(F.regexp_replace(given, r"(?i)\ABearer\s+", "") == wanted, F.lit(False))


def status_guard(n_headers: Column, header_bytes: Column, body_bytes: Column, host_ok: Column, token_ok: Column, body_ok: Column, free_slot: Column) -> Column:
    """The status that turns a request away, the first that applies; null if none does."""
    return (
        F.when(~free_slot, 503).when((n_headers > MAX_HEADERS) | (header_bytes > MAX_HEADER), 431).when(~host_ok, 403).when(~token_ok, 401)
        .when(body_bytes > MAX_BODY, 413).when(~body_ok, 400)
    )
