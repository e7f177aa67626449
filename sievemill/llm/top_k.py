"""Exact search for the largest inner products: ball trees per shard, branch and bound, shared scores to reach.

Components become floor(256 * x). Equal vectors are put together first, each with its smallest k + 1 ids, which is all
that a query can need of them, so copies don't fill the trees. Distinct vectors are cut into shards; each shard's ball
tree is built once and written. Every query gets a score to reach from a few thousand vectors that are compared with it
directly; the trees' search opens nodes by their bound on the inner product and skips those below it. A task takes its
shards one after the other and carries each query's current k-th score along, so that later shards start from it.

Queries go to the tasks in blocks of a bounded number of rows and bytes; each block meets each shard once. Nothing else of the
queries is held anywhere, and what a block leaves is k + 1 rows for each query and task. Arithmetic is exact: components
are refused (``ValueError``) if an inner product could pass 2^53.

A row is no answer to itself, but other rows of the same id are. Ids decide ties, null ids last; rows with null ids aren't
queries. Vectors that are null or hold null or non-finite components take no part; shorter ones are filled up with zeros.
Rows that repeat are queries and candidates of their own. An empty table gives an empty result. Columns other than id and
vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm.ball_tree import BallTree, Best, search
from sievemill.llm.common import stash
from sievemill.llm.vectors import integers, padded, shape, usable
from sievemill.sources.tables import spread, texts

SCALE, TOP, EVERY = 256, 5, 50
#: Distinct vectors of a shard; queries of a block; vectors that give the first scores to reach.
SHARD, BLOCK, SEEDS = 16_384, 32_768, 2048
#: Bytes of a block's vectors, and twice those of a shard's: long vectors come in smaller blocks and shards.
BLOCK_BYTES = 16 << 20
#: Stands for a null id inside the tasks: it comes last.
NO_ID = np.iinfo(np.int64).max
FOUND = "q long, vec_id long, score long"


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, width).astype(float)


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """(v, ids): each vector with its smallest ids, in order; null ids as NO_ID."""
    ids = rows.select("v", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("id"))
    by_id = Window.partitionBy("v").orderBy("id")
    few = ids.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= most_ids)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def trees(vectors: DataFrame, width: int, shard: int) -> DataFrame:
    """A ball tree in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, held = [], [], 0

        def tree() -> pa.RecordBatch:
            packed = BallTree.built(np.concatenate(rows), ids).packed()
            return pa.RecordBatch.from_pydict({f: pa.array([packed[f]], pa.binary()) for f in BallTree.FIELDS})

        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, shard)
                rows.append(matrix(part, "v", width))
                ids += [np.array(x, np.int64) for x in part.column("ids").to_pylist()]
                held += part.num_rows
                if held >= shard:
                    yield tree()
                    rows, ids, held = [], [], 0
        if held:
            yield tree()

    return vectors.mapInArrow(run, ", ".join(f"{f} binary" for f in BallTree.FIELDS))


def with_floors(queries: DataFrame, seeds: np.ndarray, width: int, k: int) -> DataFrame:
    """queries with the k-th best score among the seeds: what an answer must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = matrix(part, "v", width) @ seeds.T
                floor = np.partition(scores, -k, axis=1)[:, -k] if len(seeds) >= k else np.full(part.num_rows, -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor)], names=[*part.schema.names, "floor"])

    return queries.mapInArrow(run, "q long, query_id long, own long, v array<long>, floor double")


def found_in(shards: DataFrame, block: DataFrame, width: int, k: int) -> DataFrame:
    """(q, vec_id, score): for each query of the block and each task, the task's k best at most."""
    rows = block.select("q", "v", "floor").toArrow().combine_chunks()
    q = rows.column("q").to_numpy()
    x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(q), width).astype(float)
    floors = rows.column("floor").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floors, k)
        for batch in batches:
            for tree in batch.to_pylist():
                search(BallTree.unpacked(tree, width), x, best)
        at, place = np.nonzero(best.scores >= np.maximum(floors, np.finfo(float).min)[:, None])
        ids = best.ids[at, place]
        yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(ids, mask=ids == NO_ID), pa.array(best.scores[at, place].astype(np.int64))], names=["q", "vec_id", "score"])

    return shards.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = TOP, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row whose id is divisible by ``every``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(F.col(vector_col)), integers(F.col(vector_col), scale)).alias("v"))
    rows = stash(rows.filter("v is not null").withColumn("q", F.monotonically_increasing_id()), "vectors")
    _, longest, _ = shape(rows, "v")
    width = max(longest, 1)
    most = max(1, BLOCK_BYTES // (8 * width))
    shard, block = min(shard, max(1, most // 2)), min(block, most)
    rows = rows.withColumn("v", padded(F.col("v"), width))
    need = k + 1  # a query's own row may be among them
    distinct = stash(distinct_vectors(rows, need), "distinct-vectors")
    shards = spread(stash(trees(distinct, width, shard), "trees"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    queries = rows.filter(F.col("vec_id") % every == 0).select("q", F.col("vec_id").alias("query_id"), own.alias("own"), "v")
    first = np.array([r["v"] for r in distinct.select("v").limit(seeds).collect()], float).reshape(-1, width)
    queries = stash(with_floors(queries, first, width, need), "queries")
    blocks = -(-queries.count() // block)
    part = F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1)))
    found = [stash(found_in(shards, queries.filter(part == i), width, need), "found") for i in range(blocks)]
    if found:
        all_found = rows.sparkSession.read.schema(FOUND).parquet(*[f._stash_path for f in found])
    else:
        all_found = rows.sparkSession.createDataFrame([], FOUND)
    return without_own(all_found, queries.select("q", "query_id", "own"), k)


def without_own(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranks of what was found, a query's own row taken out. A row of the same id and score gives the same answer as it."""
    by_q = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("n", F.row_number().over(by_q)).filter(F.col("n") <= k + 1)
    met = best.join(queries, "q")
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("n"))).over(Window.partitionBy("q"))
    rank = F.col("n") - F.when(F.col("n") > F.col("at"), 1).otherwise(0)
    out = met.withColumn("at", own).filter(F.col("at").isNull() | (F.col("n") != F.col("at"))).withColumn("rank", rank.cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(texts(spark, sf_dir, "embeddings"))


SQL = f"""
WITH k AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, k.vec_id, list_inner_product(q.v, k.v)::BIGINT AS score FROM k q JOIN k ON q.rid <> k.rid WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
