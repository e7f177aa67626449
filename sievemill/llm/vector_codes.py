"""Compression of vectors to short codes: product quantisation over integer components.

Components become floor(1024 * x); a vector is cut into equal consecutive parts. At each position, equal parts are first
put together into one distinct row with a weight. Lloyd's rounds run over the distinct rows only: tasks assign them to the
nearest entries and add up weighted sums by entry, so what leaves a round is a row for each entry and component (16,384
for 4 positions of 256 entries of 16 components), whatever the size of the table. Codebooks are sent to every task; their
size is set by the parameters. At the end, codes and errors of distinct parts are joined back to the vectors: parts that
make up a thousandth or more of a position, of which there are a thousand a position at most, by a table sent to every
task, the others by exchange, so that no key is hot there.

Ties go to the lower index; unused entries stay. Arithmetic is exact: components are refused (``ValueError``) if sums of
squares could pass 2^53. Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors, and
lengths that the number of parts doesn't divide, are filled up with zeros. Rows that repeat are vectors of their own; among
rows of one id the smaller vector is the first; null ids come last. With fewer vectors than entries, a codebook has as many
entries as there are vectors. An empty table gives an empty result. Columns other than id, vector and label are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import bounded_broadcast, stash
from sievemill.llm.vectors import integers, padded, shape, usable
from sievemill.sources.tables import texts

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts with so large a share of a position's rows are joined by broadcast.
HEAVY = 1000
#: Distinct parts that are compared with a codebook at once.
AT_ONCE = 4096

Codebooks = list[np.ndarray]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> tuple[DataFrame, int, int]:
    """((rid, vec_id, label, parts), rows, components of a part). rid tells rows apart; it is fixed once written."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(usable(F.col(vector_col)), integers(F.col(vector_col), scale)).alias("v"))
    rows = stash(rows.filter("v is not null").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, longest, _ = shape(rows, "v")
    width = -(-longest // parts)
    whole = padded(F.col("v"), width * parts)
    cut = F.array(*[F.slice(whole, i * width + 1, width) for i in range(parts)])
    return rows.select("rid", "vec_id", "label", cut.alias("parts")), n, width


def first_entries(rows: DataFrame, parts: int, entries: int, width: int) -> Codebooks:
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    return [np.array([r["parts"][i] for r in found], np.int64).reshape(len(found), width) for i in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it); the lowest index of equally near ones."""
    c = book.astype(float)
    far = (c * c).sum(1)[None, :] - 2.0 * (x.astype(float) @ c.T)
    code = far.argmin(1)
    return code, ((x - book[code]) ** 2).sum(1)


def batches(found: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, position, rows of the batch at that position, their parts)."""
    for batch in found:
        for at in range(0, batch.num_rows, AT_ONCE):
            rows = batch.slice(at, AT_ONCE)
            places = rows.column("pos").to_numpy()
            x = rows.column("part").flatten().to_numpy().reshape(rows.num_rows, width)
            for pos in np.unique(places):
                mine = np.flatnonzero(places == pos)
                yield rows, int(pos), mine, x[mine]


def improved(distinct: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Codebooks after one round."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for rows, pos, mine, x in batches(found, width):
            weight = rows.column("weight").to_numpy()[mine]
            code, _ = nearest(x, books[pos])
            np.add.at(sums[pos], code, x * weight[:, None])
            np.add.at(counts[pos], code, weight)
        for pos, (s, n) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(n)
            if len(used):
                at = np.tile(np.arange(width), len(used))
                yield pa.RecordBatch.from_pydict({"pos": np.full(len(at), pos, np.int32), "entry": np.repeat(used, width).astype(np.int32), "at": at.astype(np.int32), "s": s[used].ravel(), "n": np.repeat(n[used], width)})

    part = distinct.mapInArrow(run, "pos int, entry int, at int, s long, n long")
    total = part.groupBy("pos", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = [b.copy() for b in books]
    for r in total:
        out[r["pos"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return out


def assigned(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """distinct with code and error."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pos, mine, x in batches(found, width):
            code, error = nearest(x, books[pos])
            kept = rows.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(code.astype(np.int32)), pa.array(error)], names=[*kept.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "pos int, part array<long>, weight long, code int, error long")


def joined_back(rows: DataFrame, coded: DataFrame, n: int) -> DataFrame:
    """(rid, vec_id, label, codes, error)."""
    each = rows.select("rid", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    heavy = F.col("weight") * HEAVY >= n
    few = F.broadcast(coded.filter(heavy).select("pos", "part", "code", "error"))
    met = each.join(few, ["pos", "part"], "left")
    rest = met.filter("code is null").drop("code", "error").join(coded.filter(~heavy).select("pos", "part", "code", "error"), ["pos", "part"])
    codes = met.filter("code is not null").unionByName(rest).groupBy("rid", "vec_id", "label")
    return codes.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"), F.sum("error").alias("error"))


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """((rid, vec_id, label, codes, error), codebooks). codes: indexes in the order of the parts."""
    rows, n, width = prepared(vectors, id_col, vector_col, label_col, scale, parts)
    if n == 0 or width == 0:
        none = F.when(F.lit(n > 0), F.array_repeat(F.lit(0), parts))
        return rows.select("rid", "vec_id", "label", none.alias("codes"), F.lit(0).cast("long").alias("error")), [np.zeros((min(n, entries), width), np.int64) for _ in range(parts)]
    distinct = rows.select(F.posexplode("parts").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    distinct = stash(distinct, "distinct-parts")
    books = first_entries(rows, parts, entries, width)
    for _ in range(rounds):
        books = improved(distinct, books, width)
    coded = stash(assigned(distinct, books, width), "coded-parts")
    return joined_back(rows, coded, n), books


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with the vector that its codes stand for, each component in the middle of its step."""

    @F.pandas_udf("array<double>")
    def run(found):
        return found.map(lambda c: np.concatenate([(b[i] + 0.5) / scale for b, i in zip(books, c, strict=True)]))

    return codes.withColumn("vector", run("codes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(texts(spark, sf_dir, "embeddings"))
    codes = stash(codes, "codes")
    by_label = stash(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "label-errors")
    met = codes.join(bounded_broadcast(by_label), F.col("label").eqNullSafe(F.col("l")))
    pair = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return met.select("vec_id", F.array_join(F.transform("codes", pair), "").alias("code"), F.col("error").cast("long").alias("error"), F.col("label_error").cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's rounds, one after the other, as plain tables."""
    near = "SELECT rid, pos, any_value(part) AS part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.rid, p.pos, p.part, b.entry, (list_inner_product(b.c, b.c) - 2 * list_inner_product(p.part, b.c) + list_inner_product(p.part, p.part))::BIGINT AS d FROM p JOIN b{0} b ON p.pos = b.pos) GROUP BY rid, pos"
    steps = [
        f"""k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rid, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT rid, pos, v[pos * len(v) // {PARTS} + 1 : (pos + 1) * len(v) // {PARTS}] AS part FROM k, range({PARTS}) t(pos))",
        f"b0 AS (SELECT pos, rid - 1 AS entry, part AS c FROM p WHERE rid <= {ENTRIES})",
    ]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS ({near.format(i)})")
        steps.append(f"m{i} AS (SELECT pos, entry, list(x ORDER BY at_) AS c FROM (SELECT pos, entry, at_, floor(sum(x) / count(*)) AS x FROM (SELECT pos, entry, unnest(part) AS x, unnest(range(len(part))) AS at_ FROM a{i}) GROUP BY pos, entry, at_) GROUP BY pos, entry)")
        steps.append(f"b{i + 1} AS (SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.pos = m.pos AND b.entry = m.entry)")
    steps += [
        f"f AS ({near.format(ROUNDS)})",
        "r AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rid)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY pos, entry)) AS s FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM k JOIN r USING (rid), sha"


SQL = _sql()
