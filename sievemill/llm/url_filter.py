"""URL filter by a cascade of Bloom filters: exact membership without joins.

A rule is (host, path, verdict). It fits its host and every subdomain if the url's path starts with the rule's path.
The keys that could name a rule for a url are each suffix of its host that has as many labels as some rule's host, with
each prefix of its path that is as long as some rule's path. The universe is all such keys of the whole corpus. For the rules of each verdict, level 1 of
the cascade encodes the listed keys, level 2 the keys of the universe that level 1 wrongly holds, level 3 the listed keys
that level 2 wrongly holds, and so on until no error is left: over this universe, membership is exact. A key belongs to
the list if the first level that doesn't hold it has an even number. The longest key that belongs gives rule and verdict;
with none, the url isn't listed and is allowed.

Size: level 1 has about 35 bits for each listed key, so that few keys of the universe pass it; every later level
encodes errors, of which there are fewer each time. The size is measured: a cascade of more than ``max_bytes`` is refused
(``OverflowError``) rather than broadcast. Later levels are built from distinct keys that passed, which are found in the
executors; only those (at most ``max_errors``) reach the driver. One scan finds them for the lists of all verdicts. A key with the hash of a
listed one would pass all levels; then all is built again with salted hashes.

Null urls and urls without ``://`` have empty host and path and fit no rule. Rules with an empty path fit every path.
Rows that repeat give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import UPPER

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
MAX_BYTES = 64 << 20
MAX_ERRORS = 5_000_000
#: Share of other keys that level 1 holds: about 35 bits for each listed key.
FIRST_RATE = 2.0**-24


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "\\A([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, "\\A[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys host suffix + path prefix, longest first (of equally long ones, the longer host first). labels: how many labels
    rules' hosts have; lengths: how long rules' paths are."""
    n = F.when(host == "", 0).otherwise(F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1)
    suffix = lambda k: F.substring_index(host, ".", -k)
    pairs = [
        F.when((n >= k) & (F.char_length(path) >= m), F.struct((-(F.char_length(suffix(k)) + m)).alias("less"), (-F.char_length(suffix(k))).alias("host"), F.concat(suffix(k), F.lit("\x00"), F.substring(path, 1, m)).alias("key")))
        for k in labels
        for m in lengths
    ]
    if not pairs:
        return F.array().cast("array<string>")
    return F.transform(F.array_sort(F.filter(F.array(*pairs), lambda k: k.isNotNull())), lambda k: k["key"])


def with_keys(pages: DataFrame, labels: list[int], lengths: list[int], id_col: str, url_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))


class Bloom:
    """A filter of k hashes over a bit array; each level salts its hashes."""

    def __init__(self, hashes: np.ndarray, rate: float, salt: int) -> None:
        n = max(1, len(hashes))
        self.bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.bits / n * math.log(2)))
        self.k = min(self.k, 40)
        self.salt = salt
        self.data = np.zeros((self.bits + 7) // 8, np.uint8)
        for at in self._places(hashes):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix(hashes ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            b = mix(a) | np.uint64(1)
            for i in range(self.k):
                yield ((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(keys: list[str], salt: str = "") -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest((salt + k).encode(), 42) for k in keys], np.uint64)


def hashed(key: Column, salt: str) -> Column:
    """What key_hash gives, as a signed long."""
    return F.xxhash64(F.concat(F.lit(salt), key) if salt else key)


class Cascade:
    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @property
    def n_bytes(self) -> int:
        return sum(len(x.data) for x in self.levels)

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        depth = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        for x in self.levels:
            alive = alive[x.holds(hashes[alive])]
            depth[alive] += 1
        return depth

    def belongs(self, hashes: np.ndarray) -> np.ndarray:
        return self.passed(hashes) % 2 == 1


class Clash(Exception):
    """A key of the universe has the hash of a listed one, so no filter over hashes can tell them apart."""


def build(universe: DataFrame, lists: list[list[str]], max_bytes: int = MAX_BYTES, max_errors: int = MAX_ERRORS, salt: str = "") -> list[Cascade]:
    """A cascade for each list of keys over universe (a DataFrame of one column, key; it may repeat keys), in one scan."""
    lists = [sorted(set(x)) for x in lists]
    firsts = [Bloom(key_hash(x, salt), FIRST_RATE, 1) if x else None for x in lists]
    size = sum(len(x.data) for x in firsts if x)
    if size > max_bytes:
        raise OverflowError(f"level 1 takes {size} bytes")
    if len(lists) > 62:
        raise ValueError("more than 62 lists")

    @F.pandas_udf("bigint")
    def passes(h: pd.Series) -> pd.Series:
        values = h.to_numpy().astype(np.int64).view(np.uint64)
        out = np.zeros(len(values), np.int64)
        for i, x in enumerate(firsts):
            if x:
                out |= x.holds(values).astype(np.int64) << i
        return pd.Series(out)

    listed = sum(map(len, lists))
    passed = universe.select("key", passes(hashed(F.col("key"), salt)).alias("which")).filter("which <> 0").distinct() if listed else None
    found = passed.limit(max_errors + listed + 1).collect() if listed else []
    out = []
    for i, (ours, first) in enumerate(zip(lists, firsts, strict=True)):
        known = set(ours)
        theirs = [r["key"] for r in found if r["which"] >> i & 1 and r["key"] not in known]
        if len(theirs) > max_errors:
            raise OverflowError(f"more than {max_errors} keys pass level 1")
        out.append(cascade(first, key_hash(ours, salt), key_hash(theirs, salt)) if first else Cascade([]))
    if len(found) > max_errors + listed:
        raise OverflowError(f"more than {max_errors} keys pass level 1")
    if sum(c.n_bytes for c in out) > max_bytes:
        raise OverflowError(f"the cascades take more than {max_bytes} bytes")
    return out


def cascade(first: Bloom, odd: np.ndarray, even: np.ndarray) -> Cascade:
    """All levels: each encodes the keys that the last one wrongly holds. odd: listed keys; even: others that first holds."""
    if np.isin(even, odd).any():
        raise Clash
    levels = [first]
    while len(even):
        level = Bloom(even, 0.5 if len(levels) > 1 else 2.0**-8, len(levels) + 1)
        levels.append(level)
        odd = odd[level.holds(odd)]
        even, odd = odd, even
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. rules: (host, path, verdict) triples; of rules for the same host and path the last counts."""
    table = {(h.lower(), p): v for h, p, v in rules}
    lengths, labels = sorted({len(p) for _, p in table}), sorted({h.count(".") + 1 for h, _ in table})
    rows = with_keys(pages, labels, lengths, id_col, url_col)
    universe = rows.select(F.explode("keys").alias("key"))
    verdicts = sorted(set(table.values()))
    lists = [[f"{h}\x00{p}" for (h, p), v in table.items() if v == verdict] for verdict in verdicts]
    for salt in ("", "1", "2", "3"):
        try:
            cascades = build(universe, lists, max_bytes, salt=salt)
            break
        except Clash:
            continue
    else:
        raise ValueError("keys share hashes, however salted")

    @F.pandas_udf("array<int>")
    def find(hashes: pd.Series) -> pd.Series:
        """Of each row's keys, the place (from 1) of the first that belongs to a list, and which list; null if none."""
        sizes = np.array([len(x) for x in hashes], np.int64)
        flat = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64)
        which = np.zeros(len(flat), np.int64)
        for i, c in enumerate(cascades):
            which[c.belongs(flat)] = i + 1
        ends = np.cumsum(sizes)
        at = np.flatnonzero(which)
        row = np.searchsorted(ends, at, side="right")
        row, where = np.unique(row, return_index=True)
        out = np.full(len(sizes), None, object)
        for r, x in zip(row, at[where], strict=True):
            out[r] = [int(x - ends[r] + sizes[r] + 1), int(which[x] - 1)]
        return pd.Series(out)

    found = rows.withColumn("found", find(F.transform("keys", lambda k: hashed(k, salt))))
    rule = F.translate(F.element_at("keys", F.col("found")[0]), "\x00", "")
    names = F.array(*[F.lit(v) for v in verdicts]) if verdicts else F.array(F.lit(default))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(F.when(F.col("found").isNotNull(), names[F.col("found")[1]]), F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r(h, pre, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(h || pre, len(h || pre)) AS rule, arg_max(v, len(h || pre)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
