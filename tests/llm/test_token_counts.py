from pyspark.sql import functions as F

from sievemill.llm import token_counts as t


def brute(text, pieces):
    """Best segmentation of each pre-token by trying every way to each of its places, without a trie."""
    if not text:
        return 0
    worst, total = min(pieces.values()) - 10, 0
    for word in text.split(" "):
        word = t.SPACE + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + pieces[word[s:end]], -s, best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
            if word[end - 1] not in pieces:
                ways.append((best[end - 1][0] + worst, -end, best[end - 1][1] + len(word[end - 1].encode())))
            top = max(ways, key=lambda w: w[:2])
            best.append((top[0], top[2]))
        total += best[-1][1]
    return total


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    extra = spark.createDataFrame([(1, None), (1, ""), (2, "  two  spaces \n\t"), (None, "日本 😀 x"), (3, "w" * 5000), (3, "w" * 5000)], docs.schema)
    docs = docs.unionByName(extra).withColumn("n_tokens", F.lit("clash"))
    pieces = t.vocabulary()
    want = sorted((brute(r["text"], pieces) for r in docs.collect()))
    for most in (t.MOST, 50):
        assert sorted(r["n_tokens"] for r in t.count_tokens(docs, pieces, most=most).collect()) == want


def test_counts_are_near_those_of_the_files_own_merges(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=t.VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = sum(len(model.encode(r["text"] or "")) for r in docs.collect())
    ours = t.count_tokens(docs).groupBy().sum("n_tokens").first()[0]
    assert abs(ours - own) < 0.02 * own


def test_shared_prefixes_are_scored_once():
    trie = t.Trie({c: -1.0 for c in "abcdefgh"})
    assert trie.counts(["abcd", "abce", "abf"]) == [4, 4, 3]
    assert trie.nodes == 6


def test_empty(spark):
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
