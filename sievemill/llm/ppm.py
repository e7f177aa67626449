"""Language-model scores by prediction by partial matching (PPM).

The model predicts each byte of a text's stream (lower-cased words joined by one space, then an end mark) from the five
bytes before it. Its trie of byte contexts holds the counts of all training texts. A byte is coded in the longest context
seen in training; if it didn't follow there, an escape is coded and the context is cut by its first byte. Escapes are
estimated by method D (a symbol's first count gives one half to the escape), and symbols of longer contexts are excluded
in shorter ones. Below the empty context, the bytes never seen are equally likely. The score adds the log10 probabilities.

Nothing that grows with the corpus is broadcast or gathered in one place. Texts are dealt into chunks by a hash. A chunk
reduces its texts to distinct grams (context and byte) and distinct words with training counts, packed by bucket; all grams
that end in the same context of two bytes are one branch of the trie and lie in one bucket. Buckets' counts are added up
in a tree, ``FAN_IN`` partial counts at a time, so no task holds more of them however many chunks there are. Requests (the
grams of a chunk in a bucket) are sorted behind the bucket's counts, which are thus sent and read once, and each answer goes
back to the chunk, which adds up its documents. Only the counts of byte pairs, at most 65,536, are collected, to be at hand for contexts
shorter than two bytes.

Training: texts whose crc32(id as text) mod 5 isn't 1. Null text counts as empty: just the end. A null id counts as empty
text in the crc. Ids that repeat and rows that repeat are scored each by itself. With no training text every byte has
probability 1/256, and base counts are zero. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.bytegrams import EDGE, ORDER, blocks, counted, grams, looked_up, merged, streams, summed
from sievemill.llm.common import documents, drop_stash, stash
from sievemill.llm.segments import BYTES, Prefix

FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 10 << 20
MOST_BUCKETS = 4096
#: So many partial counts are added up in one task; more make another step.
FAN_IN = 64
ANSWER = "chunk int, kind string, bucket int, payload binary"


class Branches:
    """PPM over the grams of some branches; pairs: the counts of all byte pairs (256 x 256)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> None:
        tables = {ORDER: (keys, counts)}
        for k in range(ORDER - 1, 1, -1):
            tables[k] = summed(tables[k + 1][0] & ((1 << 8 * (k + 1)) - 1), tables[k + 1][1])
        flat = pairs.ravel()
        seen = np.flatnonzero(flat)
        tables[1] = (seen, flat[seen])
        alone = pairs.sum(axis=0)
        seen = np.flatnonzero(alone)
        tables[0] = (seen, alone[seen])
        self.tables = tables
        self.contexts = {}
        for k, (g, c) in tables.items():
            ctx, first, distinct = np.unique(g >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(c, first) if len(first) else np.empty(0, np.int64)
            self.contexts[k] = (ctx, total, distinct)
        #: For each context of k + 1 bytes: the counts that its symbols have in the context of k bytes.
        self.covered = {}
        for k in range(ORDER):
            g = tables[k + 1][0]
            at, _ = looked_up(tables[k][0], g & ((1 << 8 * (k + 1)) - 1))
            first = np.searchsorted(g >> 8, self.contexts[k + 1][0])
            self.covered[k] = np.add.reduceat(tables[k][1][at], first) if len(first) else np.empty(0, np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        longer = np.full(len(keys), -1)
        for k in range(ORDER, -1, -1):
            ctx, total, distinct = self.contexts[k]
            at, known = looked_up(ctx, (keys[left] >> 8) & ((1 << 8 * k) - 1))
            rows, at = left[known], at[known]
            n, s = total[at].copy(), distinct[at].copy()
            came = longer[rows]
            esc = came >= 0
            if k < ORDER:
                n[esc] -= self.covered[k][came[esc]]
                s[esc] -= self.contexts[k + 1][2][came[esc]]
            place, hit = looked_up(self.tables[k][0], keys[rows] & ((1 << 8 * (k + 1)) - 1))
            c = self.tables[k][1][place] if len(self.tables[k][1]) else place
            live = s > 0
            done = hit & live
            out[rows[done]] += np.log10((2 * c[done] - 1) / (2 * n[done]))
            miss = ~hit & live
            out[rows[miss]] += np.log10(s[miss] / (2 * n[miss]))
            longer[rows] = at
            gone = np.zeros(len(keys), bool)
            gone[rows[done]] = True
            left = left[~gone[left]]
        unseen = 256 - len(self.tables[0][0])
        out[left] -= math.log10(max(unseen, 1))
        return out


def tokens(texts: pd.Series) -> list[list[bytes]]:
    return [t.encode().lower().split() for t in texts]


def branch(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of grams, by the context of two bytes."""
    return ((((keys >> 8) & 0xFFFF) * 40503 >> 4) % buckets).astype(np.int64)


def split(values: np.ndarray, where: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indices of values by bucket, in order."""
    order = np.argsort(where, kind="stable")
    return np.split(order, np.searchsorted(where[order], np.arange(1, buckets)))


class Words:
    """The distinct words of a chunk's streams, in the order of a 64-bit hash, and where they stand. (Within a chunk, words
    are told apart by that hash; from chunk to chunk by their bytes.)"""

    def __init__(self, parts: list[bytes]) -> None:
        hashes, begins, sizes, self.per_doc, at = [np.empty(0, np.uint64)], [], [], [], 0
        flat = b"".join(parts)
        for a, b in blocks(parts):
            size = sum(map(len, parts[a:b]))
            data = np.frombuffer(flat, np.uint8, size, at)
            ends = np.flatnonzero((data == 32) | (data == EDGE[0]))
            first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
            full = ends > first
            hashes.append(Prefix(BYTES[data]).of(first[full], ends[full]))
            begins.append(first[full] + at)
            sizes.append(ends[full] - first[full])
            docs = np.cumsum([len(p) for p in parts[a:b]])
            self.per_doc.append(np.diff(np.searchsorted(ends[full], docs), prepend=0))
            at += size
        self.per_doc = np.concatenate([*self.per_doc, np.empty(0, np.int64)]).astype(np.int64)
        self.distinct, where, self.which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        begin, size = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)[where] for x in (begins, sizes))
        self.begin, self.end, self.flat = begin, begin + size, flat

    def names(self, at: np.ndarray) -> bytes:
        return b" ".join([self.flat[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)])

    def by_bucket(self, buckets: int) -> list[np.ndarray]:
        """Which of the distinct words lie in each bucket; the same for a word in every chunk."""
        where = (self.distinct % np.uint64(buckets)).astype(np.int64)
        return split(where, where, buckets)


def request(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """What a chunk asks: for each bucket its distinct words and grams, and how often its training texts have them."""
    parts, train = streams(tokens(group["text"])), group["train"].to_numpy(bool)
    chunk = int(group["chunk"].iloc[0])
    rows = []
    words = Words(parts)
    ask = np.bincount(words.which, weights=np.repeat(train, words.per_doc), minlength=len(words.distinct)).astype(np.int64)
    for b, at in enumerate(words.by_bucket(buckets)):
        if len(at):
            rows.append((chunk, "word", b, words.names(at), ask[at].tobytes()))
    del words
    fit = counted([p for p, t in zip(parts, train, strict=True) if t])
    rest = counted([p for p, t in zip(parts, train, strict=True) if not t])
    keys, counts = merged([fit, (rest[0], np.zeros(len(rest[0]), np.int64))])
    for b, at in enumerate(split(keys, branch(keys, buckets), buckets)):
        if len(at):
            rows.append((chunk, "gram", b, np.diff(keys[at], prepend=0).tobytes(), counts[at].astype(np.uint32).tobytes()))
    pairs = np.bincount(fit[0] & 0xFFFF, weights=fit[1], minlength=65536).astype(np.int64)
    rows.append((chunk, "pair", 0, pairs.tobytes(), np.array([train.sum()], np.int64).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "names", "counts"])


REQUEST = "chunk int, kind string, bucket int, names binary, counts binary"


def add_words(group: pd.DataFrame) -> tuple[bytes, bytes]:
    total: Counter = Counter()
    for names, counts in zip(group["names"], group["counts"], strict=True):
        for w, c in zip(names.split(), np.frombuffer(counts, np.int64).tolist(), strict=True):
            if c:
                total[w] += c
    names = sorted(total)
    return b" ".join(names), np.array([total[w] for w in names], np.int64).tobytes()


def add_grams(group: pd.DataFrame, width) -> tuple[bytes, bytes]:
    found = []
    for names, counts in zip(group["names"], group["counts"], strict=True):
        k, c = np.cumsum(np.frombuffer(names, np.int64)), np.frombuffer(counts, width)
        found.append((k[c > 0], c[c > 0]))
    k, c = merged(found)
    return np.diff(k, prepend=0).tobytes(), c.astype(np.int64).tobytes()


def adder(first: bool):
    def add(group: pd.DataFrame) -> pd.DataFrame:
        kind = group["kind"].iloc[0]
        names, counts = add_words(group) if kind == "word" else add_grams(group, np.uint32 if first else np.int64)
        return pd.DataFrame({"kind": [kind], "bucket": [group["bucket"].iloc[0]], "part": [group["part"].iloc[0]], "names": [names], "counts": [counts], "total": [int(np.frombuffer(counts, np.int64).sum())], "distinct": [len(counts) // 8]})

    return add


COUNTED = "kind string, bucket int, part int, names binary, counts binary, total bigint, distinct bigint"


#: Stands for the chunk in the row of a bucket's counts, so that it comes before all requests.
MODEL = -1


def answerer(pairs: np.ndarray):
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket, each bucket's counts before its requests: the model is read and built once."""
        model = None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.chunk == MODEL:
                    counts = np.frombuffer(r.counts, np.int64)
                    model = dict(zip(r.names.split(), counts.tolist(), strict=False)) if r.kind == "word" else Branches(np.cumsum(np.frombuffer(r.names, np.int64)), counts, pairs)
                    continue
                if r.kind == "word":
                    got = np.array([model.get(w, 0) for w in r.names.split()], np.int64)
                else:
                    got = model.log10(np.cumsum(np.frombuffer(r.names, np.int64))).astype(np.float32)
                out.append(got.tobytes())
            asked = batch[batch["chunk"] != MODEL]
            yield pd.DataFrame({"chunk": asked["chunk"], "kind": asked["kind"], "bucket": asked["bucket"], "payload": out})

    return answer


def finisher(buckets: int, n: int, v: int, ends: int):
    def log10p(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def finish(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        got = {(k, b): p for k, b, p in zip(answers["kind"], answers["bucket"], answers["payload"], strict=True)}
        parts = streams(tokens(docs["text"]))
        words = Words(parts)
        count = np.zeros(len(words.distinct), np.int64)
        for b, at in enumerate(words.by_bucket(buckets)):
            if len(at):
                count[at] = np.frombuffer(got["word", b], np.int64)
        doc, n_words = np.repeat(np.arange(len(parts)), words.per_doc), words.per_doc
        base = np.bincount(doc, weights=log10p(count)[words.which], minlength=len(parts)) + log10p(np.array(ends)).item()
        known = np.bincount(doc, weights=(count > 0)[words.which], minlength=len(parts)).astype(np.int64) + (ends > 0)
        del words, doc
        keys, _ = counted(parts)
        value = np.zeros(len(keys))
        for b, at in enumerate(split(keys, branch(keys, buckets), buckets)):
            if len(at):
                value[at] = np.frombuffer(got["gram", b], np.float32)
        score = np.zeros(len(parts))
        for a, b in blocks(parts):
            g, begins = grams(parts[a:b])
            order = np.argsort(g)
            each = np.empty(len(g))
            each[order] = value[np.searchsorted(keys, g[order])]
            score[a:b] = np.add.reduceat(each, begins)
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": ~docs["train"], "n_tokens": n_words + 1, "n_known": known, "train_tokens": n, "base_score": base, "score": score})

    return finish


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document; ids must be integers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = int(min(MOST_BUCKETS, max(16, chunks)))
    train = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), train.alias("train"), chunk.alias("chunk"))
    asked = stash(rows.groupBy("chunk").applyInPandas(lambda g: request(g, buckets), REQUEST), "asked")
    known, parts, first = asked.filter("kind <> 'pair'").withColumnRenamed("chunk", "part"), chunks, True
    while first or parts > 1:
        parts = -(-parts // FAN_IN)
        known = known.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("kind", "bucket", "part").applyInPandas(adder(first), COUNTED)
        first = False
    known = stash(known, "known")
    pairs, ends = pair_counts(asked)
    n, v = known.filter("kind = 'word'").agg(F.sum("total"), F.sum("distinct")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    requests = asked.filter("kind <> 'pair'").select("kind", "bucket", "chunk", "names", F.lit(None).cast("binary").alias("counts"))
    both = requests.unionByName(known.select("kind", "bucket", F.lit(MODEL).alias("chunk"), "names", "counts"))
    both = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk")
    answers = stash(both.mapInPandas(answerer(pairs), ANSWER), "answers")
    drop_stash(asked)
    drop_stash(known)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finisher(buckets, int(n), int(v), int(ends)), SCORED)


def pair_counts(asked: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of byte pairs, added up in the executors: one array of 65,536 for each of a few tasks comes here."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, ends = np.zeros(65536, np.int64), 0
        for batch in batches:
            for names, counts in zip(batch["names"], batch["counts"], strict=True):
                total += np.frombuffer(names, np.int64)
                ends += int(np.frombuffer(counts, np.int64)[0])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": np.r_[at, -1], "n": np.r_[total[at], ends]})

    rows = asked.filter("kind = 'pair'").select("names", "counts").mapInPandas(add, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((256, 256), np.int64)
    ends = 0
    for r in rows:
        if r["pair"] < 0:
            ends = r["n"]
        else:
            pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    return pairs, ends


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
