"""Registered queries of operators that keep hot keys, long files and long logs out of single tasks, with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.operators import context, traffic
from sievemill.operators.growing_store import GrowingStore
from sievemill.plans.catalog import _SRC, _UNION, _WIN, LOGS, _sources, joined, query
from sievemill.sources.scratch import fresh_path
from sievemill.sources.tables import table

_TEXTS = """n AS (SELECT path, max(pos)::BIGINT AS n FROM sl GROUP BY path),
w AS (SELECT id, fr.path, fr.line, o, greatest(greatest(fr.line - 2, 0) - 1, 0) + 1 AS a, least(fr.line + 2, coalesce(n, 0)) AS b FROM fr JOIN src ON fr.path = src.path LEFT JOIN n ON n.path = fr.path{0}),
t AS (SELECT id, o, w.path, concat('--- ', w.path, ' (Lines ', a, '-', b, ') ---', chr(10), coalesce(string_agg(concat(pos, ' | ', sl.line, chr(10)), '' ORDER BY pos) FILTER (pos IS NOT NULL), ''), chr(10)) AS body FROM w LEFT JOIN sl ON w.path = sl.path AND pos BETWEEN a AND b GROUP BY id, o, w.path, a, b),
g AS (SELECT id, path, min(o) AS o FROM t GROUP BY id, path), gf AS (SELECT id, string_agg(path, '|' ORDER BY o) AS files FROM g GROUP BY id)
SELECT id, md5(string_agg(body, '' ORDER BY o)) AS context_md5, any_value(files) AS files FROM t JOIN gf USING (id) GROUP BY id"""


def _binned(spark, sf_dir, root=None):
    found, sources = _sources(spark, sf_dir)
    cut = context.windows_binned(found, context.source_lines(sources).hint("merge"), 2, root)
    return context.put_together(cut).select("id", F.md5("context").alias("context_md5"), joined("files", "files"))


@query(f"WITH {LOGS}, {_UNION}, {_SRC}, {_WIN}, {_TEXTS.format('')}")
def context_binned(spark, sf_dir):
    return _binned(spark, sf_dir)


@query(f"WITH {LOGS}, {_UNION}, {_SRC}, {_WIN}, " + _TEXTS.format(" WHERE NOT starts_with(fr.path, '/') OR starts_with(fr.path, '/srv/app/')"))
def context_rooted(spark, sf_dir):
    """Frames outside the root are skipped; those of relative paths lie in it."""
    return _binned(spark, sf_dir, "/srv/app")


#: Documents play the requests of one gateway: one each 13 seconds, as large as the text.
_LOG = "log AS (SELECT doc_id, (1700000000 + doc_id * 13) * 1000000 AS tm, concat(source, ':', coalesce(strlen(text), 0) % 40) AS key, coalesce(strlen(text), 0)::BIGINT AS tokens, text FROM documents)"


def _log(spark, sf_dir):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    key = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), (size % 40).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(F.col("doc_id") * 13 + 1700000000).alias("ts"), key.alias("key"), size.alias("tokens"), "text")


@query(f"WITH {_LOG} SELECT doc_id, sum(tokens) OVER (ORDER BY tm RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS hourly_tokens FROM log")
def rolling_total_tokens(spark, sf_dir):
    """One budget for all requests."""
    return traffic.rolling_total(_log(spark, sf_dir), "ts", "tokens").select("doc_id", "hourly_tokens")


#: Every request in order, and what the cache holds after it: the keys with their times, emptied at 60 of them.
@query(
    f"""WITH RECURSIVE {_LOG}, k AS (SELECT doc_id, key, tm, row_number() OVER (ORDER BY tm, doc_id) AS i FROM log),
f AS (SELECT i, doc_id, false AS hit, MAP {{key: tm}} AS held FROM k WHERE i = 1
UNION ALL SELECT k.i, k.doc_id, h, CASE WHEN h THEN held WHEN cardinality(held) >= 60 THEN MAP {{k.key: k.tm}} ELSE map_concat(held, MAP {{k.key: k.tm}}) END
FROM (SELECT f.i, f.held, coalesce(k.tm - held[k.key] < 900000000, false) AS h FROM f JOIN k ON k.i = f.i + 1) x JOIN k ON k.i = x.i + 1)
SELECT doc_id, hit FROM f"""
)
def shared_cache_hits(spark, sf_dir):
    return traffic.shared_hits(_log(spark, sf_dir), "key", "ts", "doc_id", 900, 60).select("doc_id", "hit")


@query(
    f"WITH {_LOG}, l AS (SELECT sha256(concat(key, tokens // 100)) AS hash, text, tm, row_number() OVER (PARTITION BY hash ORDER BY tm DESC, sha256(coalesce(text, '')) DESC, text DESC NULLS LAST) AS n FROM log), s AS (SELECT hash, text, tm, row_number() OVER (ORDER BY tm DESC, hash) AS place FROM l WHERE n = 1) SELECT hash, md5(text) AS content_md5, tm AS stored_us, place <= 1000 AS newest FROM s"
)
def store_growth(spark, sf_dir):
    """A store that takes the answers in three merges, and its newest entries from its lists."""
    rows = _log(spark, sf_dir).select(F.sha2(F.concat("key", F.floor(F.col("tokens") / 100).cast("string")), 256).alias("hash"), F.col("text").alias("content"), F.col("ts").alias("stored_at"), (F.col("doc_id") % 3).alias("batch"))
    held = GrowingStore(spark, fresh_path(spark, "store"), digits=1)
    for i in range(3):
        held.merge(rows.filter(F.col("batch") == i).drop("batch"))
    now = rows.agg(F.max("stored_at")).first()[0]
    newest = held.newest_entries(F.lit(now), 10**9).select("hash", F.lit(True).alias("new"))
    return held.rows().join(newest, "hash", "left").select("hash", F.md5("content").alias("content_md5"), F.unix_micros("stored_at").alias("stored_us"), F.coalesce("new", F.lit(False)).alias("newest"))
