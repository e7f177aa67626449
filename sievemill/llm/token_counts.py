"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a maximal run of anything but the space character, with the mark for a space (U+2581) before it; an empty
run between two spaces is the mark alone. The text's first run gets the mark too. A pre-token's segmentation is the row of
pieces with the highest sum of scores (of equally good ones, the one whose last piece is longest, and so on backward).
Characters that no piece covers fall back to bytes, one token each, at a score below every piece's.

A task goes through its texts in blocks. A block's distinct pre-tokens that aren't known yet are inserted into a trie by
sorting them: sorted order is the trie's depth-first order, so the forward scores of the shared prefix are still at hand,
and each node's score is computed once. The count at a terminal node is stored, and texts add up the counts of their
pre-tokens. The store of counts and its trie are emptied when they hold ``most`` pre-tokens, so memory is bounded.

The vocabulary is a file of a public tokenizer whose path is a parameter; it is read by the driver and its pieces (its size
is checked) go to the tasks. Nothing is trained. A unigram model's scores are taken as they are. The files at hand are of
byte-pair merges, whose "scores" are ranks; by the law of Zipf and Mandelbrot a piece of rank r has a probability in
proportion to 1 / (r + ``offset``), and that is its score here. So counts are those of a unigram tokenizer with this
vocabulary, not of the file's own merges; the README says how far the two are apart.

Null and empty texts have 0 tokens. Ids that repeat are counted row by row. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Added to ranks: with 100 the number of tokens of the test documents is within a hundredth of the file's own tokenizer's.
OFFSET = 100.0
MOST = 500_000
MAX_PIECES = 1_000_000
#: Texts are taken in blocks of about so many characters.
BLOCK = 1 << 22


def vocabulary(path: str = VOCABULARY, offset: float = OFFSET) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model and their log-probabilities (up to a constant)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MAX_PIECES:
        raise OverflowError(f"{model.get_piece_size()} pieces")
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(x <= 0 and x == int(x) for x in scores):
        scores = [-math.log(offset - x) for x in scores]
    return dict(zip(map(model.id_to_piece, ids), scores, strict=True))


class Automaton:
    """All pieces that end at a place of a text, found by one step for each character (Aho and Corasick's construction)."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.fail = [0]
        own: list[tuple[int, float] | None] = [None]
        for p, score in pieces.items():
            at = 0
            for c in p:
                to = self.goto[at].get(c)
                if to is None:
                    to = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(0)
                    own.append(None)
                at = to
            own[at] = (len(p), score)
        #: By state: (length, score) of the pieces that end there, the longest first.
        self.ends: list[tuple[tuple[int, float], ...]] = [()] * len(self.goto)
        level = [0]
        while level:
            after = []
            for at in level:
                for c, to in self.goto[at].items():
                    back = self.fail[at]
                    while at and c not in self.goto[back] and back:
                        back = self.fail[back]
                    self.fail[to] = self.goto[back].get(c, 0) if at else 0
                    self.ends[to] = ((own[to],) if own[to] else ()) + self.ends[self.fail[to]]
                    after.append(to)
            level = after

    def step(self, state: int, c: str) -> int:
        at = state
        while c not in self.goto[at] and at:
            at = self.fail[at]
        to = self.goto[at].get(c, 0)
        self.goto[state][c] = to
        return to


_BUILT: dict[str, Automaton] = {}


def automaton(pieces: dict[str, float], name: str | None = None) -> Automaton:
    """Built once for each process and vocabulary."""
    if name is None:
        return Automaton(pieces)
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(pieces)
    return _BUILT[name]


class Trie:
    """Counts tokens of pre-tokens that come in sorted order."""

    def __init__(self, pieces: dict[str, float], name: str | None = None) -> None:
        self.pieces = pieces
        self.automaton = automaton(pieces, name)
        #: A byte is worse than every piece, by the margin that the unigram algorithm gives unknown characters.
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.nodes = 0

    def counts(self, ordered: list[str]) -> list[int]:
        """Token counts. best[i], tokens[i]: of the best way to the i-th node of the path from the root."""
        best, tokens, states, last, out = [0.0], [0], [0], "", []
        goto, ends, step, known = self.automaton.goto, self.automaton.ends, self.automaton.step, self.pieces
        for word in ordered:
            share = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                share += 1
            del best[share + 1 :], tokens[share + 1 :], states[share + 1 :]
            state = states[-1]
            for end in range(share + 1, len(word) + 1):
                c = word[end - 1]
                to = goto[state].get(c)
                state = step(state, c) if to is None else to
                top, count = float("-inf"), 0
                if c not in known:
                    top, count = best[end - 1] + self.unknown, tokens[end - 1] + len(c.encode())
                for length, score in ends[state]:
                    score += best[end - length]
                    if score > top:
                        top, count = score, tokens[end - length] + 1
                best.append(top)
                tokens.append(count)
                states.append(state)
            self.nodes += len(word) - share
            last = word
            out.append(tokens[-1])
        return out


def pretokens(text: str) -> list[str]:
    return text.split(" ") if text else []


def counter(pieces: dict[str, float], most: int):
    name = hashlib.sha256(repr(sorted(pieces.items())).encode()).hexdigest()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, known = Trie(pieces, name), {}

        def count(texts: list[list[str]]) -> list[int]:
            new = sorted({w for t in texts for w in t} - known.keys())
            if len(known) + len(new) > most:
                known.clear()
                new = sorted({w for t in texts for w in t})
            known.update(zip(new, trie.counts([SPACE + w for w in new]), strict=True))
            return [sum(map(known.__getitem__, t)) for t in texts]

        for batch in batches:
            out, block, size = [], [], 0
            for text in batch["text"]:
                block.append(pretokens(text))
                size += len(text)
                if size > BLOCK:
                    out += count(block)
                    block, size = [], 0
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_pretokens": batch["text"].map(lambda t: t.count(" ") + 1 if t else 0), "n_tokens": out + count(block)})

    return of


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = vocabulary(path) if pieces is None else pieces
    return rows.mapInPandas(counter(pieces, most), "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
