"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A
word's likelihood is the sum over all ways to segment it into pieces, found by a
forward pass; a text's is the product over its words, as no piece spans words. The
probabilities are fitted by expectation-maximisation: a backward pass gives each
piece's expected uses under all segmentations. A round is one Spark job over the
sample's words; the driver holds the probabilities, whose number is the vocabulary's.

Training reads at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` of text per language,
those of least hash of doc_id, and all their words; prediction reads every text
whole. Words are runs of letters in lower case; word starts are marked
as in the vocabulary. Letters without a piece have a small fixed probability.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows
with a null language or id are not learnt from; without a language to learn, every
text is ``und``; equal likelihoods go to the first language by name; ids may repeat,
also with unlike languages, as a row is learnt from under its own; an empty table gives no rows, and a
model without languages; words of any length are learnt from; other columns are not
read. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_sample, lean, prepare, texts

SAMPLE, SAMPLE_BYTES = 400, 4 << 20
ROUNDS = 3
#: Longest piece in characters, and the probability of a character that no piece covers.
LONGEST, UNCOVERED = 12, 1e-7
UND = "und"
#: Words whose likelihoods a worker keeps, and the longest that are scored together.
KEPT = 400_000
TOGETHER = 36
#: Words of one piece of training work, and what a piece used once counts.
CHUNK, UNIT = 4000, 1 << 40
_MARK = "▁"

_WORDS = re.compile(r"[^\W\d_]+").findall


def letters(text: str | None) -> list[str]:
    """The words of a text; none if no character is a letter (superscripts are not)."""
    words = _WORDS((text or "").lower())
    if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w):
        return words
    return []


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without a word-start mark, of a SentencePiece model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    kept = {p.lower() for p in pieces if len(p) <= LONGEST and (p.lstrip(_MARK).isalpha() or p == _MARK)}
    return sorted(kept)


@dataclass
class Model:
    """Log-free piece probabilities, one row of languages per piece; its size is the vocabulary's."""

    languages: list[str]
    pieces: dict[str, int]
    probabilities: np.ndarray

    def forward(self, word: str) -> list[float]:
        """Log-likelihood of a word in every language, over all segmentations."""
        word = _MARK + word
        n, width = len(word), len(self.languages)
        get, table = self.pieces.get, self.rows
        alpha: list[list[float] | None] = [None] * (n + 1)
        alpha[0] = [1.0] * width
        log = 0.0
        for i in range(n):
            here = alpha[i]
            if here is None:
                continue
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                k = get(word[i:j])
                if k is None:
                    if j > i + 1:
                        continue
                    row = self.none  # a single character is always passable
                else:
                    row = table[k]
                there = alpha[j]
                if there is None:
                    alpha[j] = [a * p for a, p in zip(here, row, strict=True)]
                else:
                    alpha[j] = [t + a * p for t, a, p in zip(there, here, row, strict=True)]
            if i % 24 == 23:  # rescale long words before they underflow
                peak = max(max(a) for a in alpha[i + 1:] if a is not None)
                for j in range(i + 1, n + 1):
                    if alpha[j] is not None:
                        alpha[j] = [a / peak for a in alpha[j]]
                log += float(np.log(peak))
        return [log + (float(np.log(a)) if a > 0 else -745.0) for a in alpha[n]]

    def forward_many(self, words: list[str]) -> np.ndarray:
        """:meth:`forward` of many words, those of one length together."""
        out = np.empty((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        none, single = len(self.probabilities), len(self.probabilities) + 1
        table = np.vstack([self.probabilities, np.zeros(len(self.languages)), self.none])
        get = self.pieces.get
        for n, members in by_length.items():
            if n > TOGETHER:
                for k in members:
                    out[k] = self.forward(words[k])
                continue
            spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)]
            for at in range(0, len(members), 2048):
                some = members[at: at + 2048]
                marked = [_MARK + words[k] for k in some]
                alpha = np.zeros((n + 1, len(some), len(self.languages)))
                alpha[0] = 1.0
                for i, j in spans:
                    default = single if j == i + 1 else none
                    found = np.asarray([get(w[i:j], default) for w in marked])
                    live = np.flatnonzero(found != none)
                    if len(live):
                        alpha[j, live] += alpha[i, live] * table[found[live]]
                out[some] = np.log(np.maximum(alpha[n], 1e-320))
        return out

    @property
    def rows(self) -> list[list[float]]:
        if "_rows" not in self.__dict__:
            self._rows = self.probabilities.tolist()
        return self._rows

    @property
    def none(self) -> list[float]:
        return [UNCOVERED] * len(self.languages)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


class Likelihoods:
    """A bounded table of words' log-likelihoods; a full one is started anew."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((KEPT, max(1, len(model.languages))))
        self.places: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > len(self.rows):
            self.places, new = {}, list(words)
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]))
        at = len(self.places)
        self.rows[at: at + len(new)] = self.model.forward_many(new)
        self.places.update(zip(new, range(at, at + len(new)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(0)


def _expected(words: list[str], counts: list[int], index: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the counted words.

    Words of one length go together; longer ones one by one, in logarithms, so that
    none underflows. A letter without a piece is passed as in prediction, and counts
    for no piece.
    """
    table = np.append(p, [0.0, UNCOVERED])
    none, single = len(p), len(p) + 1
    used = np.zeros(len(table))
    by_length: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        by_length[len(w) + 1].append(k)
    for n, members in by_length.items():
        if n > TOGETHER:
            for k in members:
                _expected_long(_MARK + words[k], counts[k], index, p, used)
            continue
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)]
        for at in range(0, len(members), 2048):
            some = members[at: at + 2048]
            marked = [_MARK + words[k] for k in some]
            alpha, beta, found = np.zeros((n + 1, len(some))), np.zeros((n + 1, len(some))), {}
            alpha[0] = beta[n] = 1.0
            for i, j in spans:
                default = single if j == i + 1 else none
                found[i, j] = np.fromiter((index.get(w[i:j], default) for w in marked), np.int64, len(some))
                alpha[j] += alpha[i] * table[found[i, j]]
            for i, j in reversed(spans):
                beta[i] += beta[j] * table[found[i, j]]
            each = np.asarray([counts[k] for k in some], float) / alpha[n]
            for (i, j), k in found.items():
                used += np.bincount(k, alpha[i] * table[k] * beta[j] * each, len(table))
    return used[:none]


def _expected_long(word: str, count: int, index: dict[str, int], p: np.ndarray, used: np.ndarray) -> None:
    n, logs, uncovered = len(word), np.log(p).tolist(), math.log(UNCOVERED)

    def edge(i: int, j: int) -> tuple[int | None, float]:
        k = index.get(word[i:j])
        return k, logs[k] if k is not None else uncovered if j == i + 1 else -math.inf

    def summed(terms: list[float]) -> float:
        peak = max(terms)
        return peak + math.log(sum(math.exp(t - peak) for t in terms))

    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = summed([alpha[i] + edge(i, j)[1] for i in range(max(0, j - LONGEST), j)])
    for i in range(n - 1, -1, -1):
        beta[i] = summed([beta[j] + edge(i, j)[1] for j in range(i + 1, min(n, i + LONGEST) + 1)])
    for i in range(n):
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            k, log = edge(i, j)
            if k is not None:
                used[k] += count * math.exp(alpha[i] + log + beta[j] - alpha[n])


def _rounds(spark: SparkSession | None, chunks: list[tuple[int, list[str], list[int]]], index: dict[str, int], n: int) -> np.ndarray:
    """Piece probabilities (pieces, languages) after all rounds over chunks (language, words, counts).

    With a session the chunks are tasks' work; what comes back is one number per
    piece and language. Expected uses are added up as integers, in any order alike.
    """
    p = np.full((len(index), n), 1 / max(1, len(index)))
    if spark is not None and chunks:
        work = spark.createDataFrame(chunks, "lang int, words array<string>, counts array<long>").repartition(spark.sparkContext.defaultParallelism)
    for _ in range(ROUNDS):
        total = np.zeros(p.shape, np.int64)
        if spark is None:
            for lang, words, counts in chunks:
                total[:, lang] += np.round(_expected(words, counts, index, p[:, lang]) * UNIT).astype(np.int64)
        elif chunks:
            shared = spark.sparkContext.broadcast((index, p))

            def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                index, p = shared.value
                for b in batches:
                    for lang, words, counts in zip(*(c.to_pylist() for c in b.columns)):
                        used = np.round(_expected(words, counts, index, p[:, lang]) * UNIT).astype(np.int64)
                        at = np.flatnonzero(used)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at), pa.array(used[at])], ["lang", "piece", "used"])

            for r in work.mapInArrow(lean(count), "lang int, piece long, used long").groupBy("lang", "piece").agg(F.sum("used").alias("used")).collect():
                total[r["piece"], r["lang"]] = r["used"]
            shared.unpersist()
        used = total / UNIT + 0.01
        p = used / used.sum(0)
    return p


def train(rows: list[tuple[str | None, str]], pieces: list[str], spark: SparkSession | None = None) -> Model:
    """Fit on (text, language) rows: as Spark tasks, or in this process where no session is given."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        words[lang].update(_WORDS((text or "").lower()))
    languages = sorted(lang for lang in words if words[lang])
    index = {p: k for k, p in enumerate(pieces)}
    chunks = []
    for column, lang in enumerate(languages):
        common = sorted(words[lang].items(), key=lambda x: (len(x[0]), x[0]))
        for at in range(0, len(common), CHUNK):
            some = common[at: at + CHUNK]
            chunks.append((column, [w for w, _ in some], [c for _, c in some]))
    return Model(languages, index, _rounds(spark, chunks, index, len(languages)))


def sample(docs: DataFrame, learn: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str | None, str]]:
    """At most ``most`` rows and ``most_bytes`` of text of each language, each row with its own language."""
    return bounded_sample(texts(docs, "lang").withColumn("y", F.col("lang").cast("string")).where(learn & F.col("y").isNotNull()), most, most_bytes)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the share of the likelihood, per word) of every text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = m.__dict__.setdefault("_known", Likelihoods(m))
        for batch in batches:
            column = batch.column("text")
            for at in range(0, len(batch), 256):
                split = [letters(t) for t in column[at: at + 256].to_pylist()]
                if m.languages:
                    known.learn(set().union(*split))
                langs, scores = [], []
                for words in split:
                    if not words or not m.languages:
                        langs.append(UND), scores.append(0.0)
                        continue
                    total = known.total(words)
                    best = int(np.argmax(total))
                    share = np.exp(np.maximum((total - total[best]) / len(words), -50))
                    langs.append(m.languages[best]), scores.append(float(1 / share.sum()))
                ids = batch.column("doc_id")[at: at + 256]
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(lean(guess), "doc_id long, lang_pred string, score double")
