"""Reading level of documents (problem 9).

Every sentence is classed by a regularised softmax over its words and their character n-grams, which is trained on the
sentences of graded documents. A document's distribution of sentence levels then goes through a second softmax that
was fitted on held-out sentence predictions, and so gives a calibrated grade.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share


GRADES = 4
#: Most graded documents the models are fitted on (chosen by a hash of the id); the rest of the labels is left for checks.
TRAIN_DOCS = 6000
BUCKETS, N_GRAMS = 1 << 13, (3, 4)
ROUNDS, RATE, L2 = 160, 0.08, 2e-4
#: Words whose parts a task keeps; beyond, it begins anew.
KEPT_WORDS = 200_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence in lower case; numbers are one word. A text without words is one empty sentence."""
    parts = [["0" if w[0].isdigit() else w for w in _WORD.findall(s.lower())] for s in _SENTENCE.split(text)]
    return [p for p in parts if p] or [[""]]


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in N_GRAMS for i in range(max(0, len(w) - n + 1))]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _adam(grad, params: list[np.ndarray], rounds: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for p, g, a, b in zip(params, grad(), m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def _shape(words: list[str]) -> list[float]:
    """Length of a sentence and of its words."""
    n = len(words)
    return [np.log1p(n) - 2.5, sum(map(len, words)) / n / 5 - 1, sum(len(w) > 8 for w in words) / n - 0.2]


@dataclass
class SentenceModel:
    """Softmax on words, character n-grams and lengths; a word's part of the score is worked out once and kept."""

    words: dict[str, int]
    by_word: np.ndarray
    by_gram: np.ndarray
    by_shape: np.ndarray
    bias: np.ndarray
    kept: dict[str, int] = field(default_factory=dict)
    parts: np.ndarray = field(default_factory=lambda: np.zeros((1024, GRADES)))

    def part(self, word: str) -> np.ndarray:
        g = grams(word)
        out = self.by_gram[g].mean(axis=0) if g else np.zeros(GRADES)
        i = self.words.get(word)
        return out if i is None else out + self.by_word[i]

    def row(self, word: str) -> int:
        """Row of ``parts`` that keeps a word's part; it is worked out when the word is first met."""
        i = self.kept[word] = len(self.kept)
        if i == len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        self.parts[i] = self.part(word)
        return i

    def predict(self, found: list[list[str]]) -> np.ndarray:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        get = self.kept.get
        rows = [i if (i := get(w)) is not None else self.row(w) for s in found for w in s]
        at = np.cumsum([0, *map(len, found)])
        mean = np.add.reduceat(self.parts[rows], at[:-1]) / np.diff(at)[:, None]
        return softmax(mean + np.array([_shape(s) for s in found]) @ self.by_shape + self.bias)


def fit_sentences(docs: list[list[list[str]]], target: np.ndarray) -> SentenceModel:
    """Train on all sentences, each with its document's grade distribution as its target."""
    seen: dict[str, int] = {}
    counts: dict[str, int] = {}
    for d in docs:
        for s in d:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
    for w in sorted(counts):
        if counts[w] >= 3:
            seen[w] = len(seen)
    vocabulary = sorted(counts)
    number = {w: i for i, w in enumerate(vocabulary)}
    flat = np.array([number[w] for d in docs for s in d for w in s])
    length = np.array([len(s) for d in docs for s in d])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    shape = np.array([_shape(s) for d in docs for s in d])
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    sentence = np.repeat(np.arange(len(length)), length)
    share = (1 / length)[sentence]
    y = target[owner]
    # a document weighs the same however many sentences it has
    weight = (1 / np.bincount(owner))[owner] / len(docs)
    gram_lists = [grams(w) for w in vocabulary]
    g_flat = np.array([g for x in gram_lists for g in x], dtype=np.int64)
    g_word = np.repeat(np.arange(len(vocabulary)), [len(x) for x in gram_lists])
    g_share = np.array([1 / len(x) for x in gram_lists for _ in x])
    known = np.array([seen.get(w, -1) for w in vocabulary])
    inside = known >= 0
    by_word, by_gram = np.zeros((len(seen), GRADES)), np.zeros((BUCKETS, GRADES))
    by_shape, bias = np.zeros((shape.shape[1], GRADES)), np.zeros(GRADES)

    def spread(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, weights=values[:, c], minlength=size) for c in range(GRADES)], axis=1)

    def grad() -> list[np.ndarray]:
        part = spread(g_word, by_gram[g_flat] * g_share[:, None], len(vocabulary))
        part[inside] += by_word[known[inside]]
        score = np.add.reduceat(part[flat], at) / length[:, None] + shape @ by_shape + bias
        d = (softmax(score) - y) * weight[:, None]
        word = spread(flat, d[sentence] * share[:, None], len(vocabulary))
        gw = np.zeros_like(by_word)
        gw[known[inside]] = word[inside]
        gg = spread(g_flat, word[g_word] * g_share[:, None], BUCKETS)
        return [gw + L2 * by_word / 50, gg + L2 * by_gram / 50, shape.T @ d + L2 * by_shape, d.sum(axis=0)]

    _adam(grad, [by_word, by_gram, by_shape, bias], ROUNDS, RATE)
    return SentenceModel(seen, by_word, by_gram, by_shape, bias)


def summary(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document's sentence levels look like: mean by sentence and by word, spread, tails and shares of each level."""
    level = p @ np.arange(1, GRADES + 1)
    by_word = (p * words[:, None]).sum(axis=0) / words.sum()
    top = np.bincount(p.argmax(axis=1), minlength=GRADES) / len(p)
    return np.concatenate([p.mean(axis=0), by_word, top, [level.mean(), level.std(), *np.quantile(level, [0.1, 0.5, 0.9]), np.log(len(p)), 1.0]])


@dataclass
class DocumentModel:
    sentence: SentenceModel
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(self.sentence, sentences(t)) for t in texts])
        return softmax((x - self.centre) / self.scale @ self.weights)

    @staticmethod
    def features(model: SentenceModel, found: list[list[str]]) -> np.ndarray:
        return summary(model.predict(found), np.array([len(s) for s in found], float))


def _fit_part(docs: list[list[list[str]]], target: np.ndarray, fold: np.ndarray, k: int) -> tuple[SentenceModel, np.ndarray, np.ndarray]:
    """The sentence model of all documents outside fold ``k``, and what it says of those inside; no document is in fold -1."""
    held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
    if k >= 0 and not (len(held) and len(rest)):
        held = rest = np.arange(len(docs))
    model = fit_sentences([docs[i] for i in rest], target[rest])
    return model, held, np.array([DocumentModel.features(model, docs[i]) for i in held])


def _fit_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts, target, fold = pickle.loads(shared.value)
                docs = [sentences(t) for t in texts]
                done = []
                for k in batch["k"].to_pylist():
                    m, held, x = _fit_part(docs, target, fold, k)
                    done.append(pickle.dumps(((m.words, m.by_word, m.by_gram, m.by_shape, m.bias), held, x)))
                yield pa.RecordBatch.from_arrays([batch["k"], pa.array(done, pa.binary())], names=["k", "part"])

    return run


def fit(texts: list[str], target: np.ndarray, folds: int = 2, spark: SparkSession | None = None) -> DocumentModel:
    """Both models; the second sees only predictions for documents that the first was not trained on.

    With a session the fits of the folds and the one on all documents are tasks of one job.
    """
    fold = np.random.default_rng(5).permutation(len(texts)) % folds
    numbers = [*range(folds), -1]
    if spark is None:
        docs = [sentences(t) for t in texts]
        parts = {k: _fit_part(docs, target, fold, k) for k in numbers}
    else:
        asked = spark.createDataFrame([(k,) for k in numbers], "k long").repartitionByRange(len(numbers), "k")
        done = asked.mapInArrow(_fit_task(share(spark, (texts, target, fold))), "k long, part binary").collect()
        found = {r["k"]: pickle.loads(r["part"]) for r in done}
        parts = {k: (SentenceModel(*m), held, features) for k, (m, held, features) in found.items()}
    x = np.zeros((len(texts), len(summary(np.ones((1, GRADES)), np.ones(1)))))
    for k in range(folds):
        _, held, features = parts[k]
        x[held] = features
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    centre[-1], scale[-1] = 0.0, 1.0
    z = (x - centre) / scale
    w = np.zeros((z.shape[1], GRADES))
    _adam(lambda: [z.T @ (softmax(z @ w) - target) / len(z) + 1e-4 * w], [w], 400, 0.05)
    return DocumentModel(parts[-1][0], centre, scale, w)


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DocumentModel | None:
    """Fit on at most ``limit`` graded English documents; several raters of one document are averaged. None without any."""
    marks = labels.where(f"doc_id is not null and grade between 1 and {GRADES}").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.avg((F.col("grade") == g).cast("double")).alias(f"g{g}") for g in range(1, GRADES + 1)])
    # four labels for each wanted document, since some are of other languages or blank; so many may be broadcast
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * limit)
    graded = english(documents).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = graded.select("text", *[f"g{g}" for g in range(1, GRADES + 1)]).collect()
    if not rows:
        return None
    return fit([r[0] for r in rows], np.array([r[1:] for r in rows], float), spark=documents.sparkSession)


def english(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.where((F.col("lang") == "en") & text.rlike(r"\S")).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _grader(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            p = fitted.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(p.argmax(axis=1) + 1, pa.int32()), pa.array(p.max(axis=1)), pa.array(p @ np.arange(1, GRADES + 1))],
                names=["doc_id", "grade", "confidence", "level"],
            )

    return run


def grade_documents(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, grade`` (1 to 4), ``confidence`` and ``level`` (expected grade) of every English non-blank document.

    ``documents``: ``doc_id, lang, text``; ``labels``: ``doc_id, grade``; other columns are ignored, whole texts are read.
    Repeated rows are graded each alike. Without any usable label the result is empty.
    """
    spark = documents.sparkSession
    model = train(documents, labels, limit)
    schema = "doc_id long, grade int, confidence double, level double"
    if model is None:
        return spark.createDataFrame([], schema)
    # the model's size is bounded by the training sample
    shared = share(spark, model)
    return english(documents).mapInArrow(_grader(shared), schema)


def profile(graded: DataFrame) -> DataFrame:
    """Documents per grade with the mean level and confidence."""
    return graded.groupBy("grade").agg(F.count("*").alias("docs"), F.avg("level").alias("mean_level"), F.avg("confidence").alias("mean_confidence"))
