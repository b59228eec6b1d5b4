"""Language identification by segmentation-marginalised unigrams.

A word is a start mark and its lower-cased letters with their combining marks. Over a fixed public vocabulary of pieces, each
language has a probability for each piece (bytes of a character stand in where no piece does), and a word's probability is
the sum over all its segmentations into pieces, by the forward algorithm, however long the word is. Each word is with
probability FOREIGN (names, quotations) drawn from all languages alike, so no word decides alone. A text's score is the sum of
its words' logarithms.

Piece probabilities are learned by expectation-maximisation: expected piece counts by forward-backward over the counted
words of each language, one Spark aggregation a round; there, words of over LONGEST letters are learned in stretches. The labelled rows used are a bounded sample: about PER_LANGUAGE per
language, chosen by a hash of their position-free key; everything else covers all rows.

Cases: null text or text without a letter is `und` with score 0; null lang teaches nothing; without any labelled row every
text is `und`; repeated rows each get a result and count as often as they stand in learning; ties go to the language that
sorts first; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, local_file, map_rows

#: Labelled documents per language that are learned from, about.
PER_LANGUAGE = 1500
ROUNDS = 3
#: Letters of a word whose probability is summed as it is; those of longer words, which could underflow, in logarithms.
LONGEST = 20
#: The share of words that may be of any language.
FOREIGN = 0.002
MARK = "▁"


@lru_cache(maxsize=1)
def _letters() -> re.Pattern:
    """Runs of letters and combining marks (Unicode categories L and M), as one class of ranges."""
    kinds = groupby(range(sys.maxunicode + 1), key=lambda c: unicodedata.category(chr(c))[0] in "LM")
    runs = [list(run) for ok, run in kinds if ok]
    return re.compile("[" + "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs) + "]+")


def words_of(text: str | None) -> list[str]:
    return _letters().findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    """Whether a word has a letter: runs of combining marks have none."""
    return any(any(map(str.isalpha, w)) for w in words)


def stretches(word: str) -> list[str]:
    """The parts of a word that are learned from."""
    return [MARK + word] if len(word) <= LONGEST else [MARK * (at == 0) + word[at : at + LONGEST] for at in range(0, len(word), LONGEST)]


class Pieces:
    """The vocabulary: pieces to numbers; the last 256 are bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.number = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names))
        self.bytes_from = len(names)
        self.size = len(names) + 256
        self.heads = {p[:k] for p in names for k in range(1, len(p) + 1)}

    def arcs(self, word: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, pieces) of each step through the word, by start; a character that is no piece is its bytes."""
        n = len(word)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = word[i:j]
                if s not in self.heads:
                    break
                if (p := self.number.get(s)) is not None:
                    yield i, j, (p,)
            if word[i] not in self.number:
                yield i, i + 1, tuple(self.bytes_from + b for b in word[i].encode("utf-8", "replace"))

    def log_total(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """The logarithm of a word's probability, per language; only the places that a piece can reach are held."""
        ring = np.full((self.longest + 1, log_prob.shape[1]), -np.inf)
        ring[0], last = 0, 0
        for i, j, p in self.arcs(word):
            if i > last:
                ring[last % len(ring)] = -np.inf  # left behind: the place is used again
                last = i
            at = j % len(ring)
            ring[at] = np.logaddexp(ring[at], ring[i % len(ring)] + log_prob[list(p)].sum(axis=0))
        return ring[len(word) % len(ring)]


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


class Lattice:
    """All steps through many words, in order of their ends, for passes over all words at once."""

    def __init__(self, pieces: Pieces, words: list[str]):
        word, start, end, piece, extra = [], [], [], [], []
        for k, w in enumerate(words):
            for i, j, p in pieces.arcs(w):
                word.append(k)
                start.append(i)
                end.append(j)
                piece.append(p[0])
                if len(p) > 1:
                    extra.append((len(piece) - 1, p[1:]))
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        order = np.lexsort((self.word, self.end))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.word, self.start, self.end, self.piece = (x[order] for x in (self.word, self.start, self.end, self.piece))
        self.extra = [(int(back[a]), p) for a, p in extra]
        self.n = len(words)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.most = int(self.sizes.max()) if words else 0
        self.cuts = np.searchsorted(self.end, np.arange(self.most + 2))

    def weights(self, prob: np.ndarray) -> np.ndarray:
        """prob: (pieces, languages). The probability of each step, per language."""
        w = prob[self.piece]
        for at, more in self.extra:
            for p in more:
                w[at] *= prob[p]
        return w

    def forward(self, w: np.ndarray) -> np.ndarray:
        """(words, places, languages): the probability of all ways to each place. Words are short, so nothing underflows."""
        alpha = np.zeros((self.n, self.most + 1, w.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, self.most + 1):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                flow = alpha[self.word[a:b], self.start[a:b]] * w[a:b]
                first = np.flatnonzero(np.r_[True, self.word[a + 1 : b] != self.word[a : b - 1]])
                alpha[self.word[a:b][first], j] = np.add.reduceat(flow, first, axis=0)
        return alpha

    def total(self, w: np.ndarray) -> np.ndarray:
        alpha = self.forward(w)
        return alpha[np.arange(self.n), self.sizes]

    def expected(self, w: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each step, per language; times: (words, languages)."""
        alpha = self.forward(w)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.sizes] = times / np.maximum(alpha[np.arange(self.n), self.sizes], 1e-300)
        uses = np.zeros_like(w)
        for j in range(self.most, 0, -1):
            a, b = self.cuts[j], self.cuts[j + 1]
            if a < b:
                flow = beta[self.word[a:b], j] * w[a:b]
                uses[a:b] = flow * alpha[self.word[a:b], self.start[a:b]]
                np.add.at(beta, (self.word[a:b], self.start[a:b]), flow)
        return uses


def learned_from(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's text isn't 2 modulo 4 teach; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def train(labelled: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(doc_id, text, lang) to the languages and (pieces, languages) probabilities."""
    spark = labelled.sparkSession
    model = local_file(vocabulary)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    if not sizes:
        return [], np.zeros((0, 0))
    languages = [r.lang for r in sizes]
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_language / r["count"]))))
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def counted(it):
        for lang, text in it:
            own: dict[str, int] = {}
            for word in words_of(text):
                for s in stretches(word):
                    own[s] = own.get(s, 0) + 1
            for s, n in own.items():
                yield lang, s, n

    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    words = checkpointed(map_rows(sample, counted, "lang string, word string, n long", schema).groupBy("word", "lang").agg(F.sum("n").alias("n")))
    at = {lang: k for k, lang in enumerate(languages)}
    size = _pieces(model).size
    sent = spark.sparkContext.broadcast(model)
    prob = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def expected(batches, now=now):
            for b in batches:
                words_, langs, n = (c.to_pylist() for c in b.columns)
                lattice = Lattice(_pieces(sent.value), words_)
                times = np.zeros((len(words_), len(languages)))
                times[np.arange(len(words_)), [at[x] for x in langs]] = n
                uses = lattice.expected(lattice.weights(now.value), times)
                total = np.zeros((size, len(languages)))
                np.add.at(total, lattice.piece, uses)
                for k, more in lattice.extra:
                    for p in more:
                        total[p] += uses[k]
                p, lang = np.nonzero(total > 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[p, lang], pa.float64())], names=["piece", "lang", "uses"])

        found = words.select("word", "lang", "n").mapInArrow(expected, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        counts = np.zeros_like(prob)
        for r in found.collect():  # at most a row per piece and language
            counts[r.piece, r.lang] = r.uses
        counts = np.round(counts, 6) + 0.05
        prob = counts / counts.sum(axis=0)
    return languages, prob


class Scorer:
    """Words to log probabilities per language, relative to the word's best one, kept in a bounded table."""

    MOST = 400_000

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob, self.log_prob = pieces, prob, np.log(prob)
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, prob.shape[1]))

    def logs(self, words: list[str]) -> np.ndarray:
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        out = np.zeros((len(words), self.prob.shape[1]))
        if short:
            lattice = Lattice(self.pieces, [MARK + words[k] for k in short])
            out[short] = np.log(np.maximum(lattice.total(lattice.weights(self.prob)), 1e-300))
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                out[k] = self.pieces.log_total(MARK + w, self.log_prob)
        own = np.exp(out - out.max(axis=1, keepdims=True))
        return np.log((1 - FOREIGN) * own + FOREIGN * own.mean(axis=1, keepdims=True))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.MOST:
            self.at, new = {}, list(words)
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            first = len(self.at)
            while first + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(part)] = self.logs(part)
            self.at.update(zip(part, range(first, first + len(part))))

    def score(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)


def predict(docs: DataFrame, languages: list[str], prob: np.ndarray, vocabulary: str) -> DataFrame:
    """(doc_id, text) to doc_id, lang_pred and score, the posterior of the predicted language under equal priors."""
    model = docs.sparkSession.sparkContext.broadcast((local_file(vocabulary), languages, prob))

    def rows(it):
        file, names, p = model.value
        scorer = Scorer(_pieces(file), p) if names else None
        part: list = []

        def done():
            if scorer is not None:
                scorer.learn({w for _, words in part for w in words})
            for doc_id, words in part:
                if scorer is None or not has_letter(words):
                    yield doc_id, "und", 0.0
                    continue
                total = scorer.score(words)
                best = int(np.argmax(total))
                yield doc_id, names[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())

        held = 0
        for doc_id, text in it:
            words = words_of(text)
            part.append((doc_id, words))
            held += len(words)
            if held >= 100_000:
                yield from done()
                part, held = [], 0
        yield from done()

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_rows(columns_only(docs, "doc_id", "text"), rows, "doc_id long, lang_pred string, score double", schema)


def identify(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    given = columns_only(docs, "doc_id", "text", "lang")
    languages, prob = train(given.where(learned_from(F.col("doc_id"))), vocabulary, **how)
    found = predict(docs, languages, prob, vocabulary)
    return found.select("doc_id", F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
