"""Quality classifier: a factorisation machine.

Features of a document are its hashed lower-cased words, structure statistics
(how much of it is symbols, capitals, digits, repeated windows, repeated
lines ...) and its stated length as metadata.  The score is the sigmoid of

    w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairwise interactions of rank ``RANK`` in time linear in the features.

The model is fitted on the driver to a bounded sample: at most ``PER_CLASS``
labelled rows of each class outside the held-out fold, those whose hashed ids
are the smallest, so that reruns agree.  A row has ``DIMENSIONS`` and a few
numbers, hence the sample has a size bound whatever the texts' lengths; only
its non-zero features are held, and ``BLOCK`` rows at once are spread out.
Scoring passes over every whole text once, without a shuffle.

Defined results: null and empty texts have no words and are scored on their
structure; a null doc_id counts as an empty string in the fold's checksum;
rows without a quality label, or whose label is neither 0 nor 1, are not learnt
from; repeated rows get equal scores; without a row of both classes the score
is the share of class 1 (one half without any); an empty table gives no rows.
Labels, language, source and id are no inputs of a score; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship
from ._text import SpanHasher, in_steps, lowered, utf8_arrays, word_spans
from .line_quality import repeated_words, used_lines, word_chars

DIMENSIONS = 4096
RANK = 8
PER_CLASS = 2000
#: Rows of the sample that the fit spreads out at once.
BLOCK = 200
ROUNDS = 120
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.3
FOLDS = 5

_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?|=_~^@/\\{}[]", dtype=np.uint8)

STRUCTURE = ("bias", "words", "word length", "symbols", "capitals", "digits", "marks", "repeated windows", "repeated lines", "short lines", "distinct words", "stated length", "no stated length")
WIDTH = DIMENSIONS + len(STRUCTURE)


def features(buf: np.ndarray | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """One document's non-zero features, places and values: ``DIMENSIONS`` hashed words, scaled to length 1, then ``STRUCTURE``."""
    own = np.zeros(len(STRUCTURE), dtype=np.float32)
    places, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    low = None if buf is None or not len(buf) else lowered(buf)
    starts, ends = word_spans(low) if low is not None else (places, places)
    n = len(starts)
    if n:
        hashes = SpanHasher(low)
        words = hashes(starts, ends)
        counts = np.bincount((words % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
        places = np.flatnonzero(counts)
        logs = np.log1p(counts[places])
        values = (logs / np.sqrt((logs * logs).sum())).astype(np.float32)
        used, _, _, repeated_lines = used_lines(low, starts, hashes)
        chars, n_lines, size = word_chars(low, starts, ends), len(used), len(buf)
        of = np.bincount(buf, minlength=256)
        capitals, digits, marks = of[65:91].sum() / size, of[48:58].sum() / size, of[_MARKS].sum() / size
        own[1:11] = np.log1p(n) / 10, min(1.0, chars / n / 20), min(1.0, 4 * of[_SYMBOLS].sum() / chars), min(1.0, 2 * capitals), min(1.0, 4 * digits), min(1.0, 10 * marks), repeated_words(words) / n, repeated_lines / n_lines, min(1.0, n_lines / n * 5), len(np.unique(words)) / n
    own[0] = 1.0
    if stated is None:
        own[12] = 1.0
    else:
        own[11] = np.log1p(max(0, stated)) / 12
    there = np.flatnonzero(own)
    return np.concatenate([places, there + DIMENSIONS]), np.concatenate([values, own[there]])


@dataclass
class Machine:
    """w0 is the weight of the feature that is always 1."""

    w: np.ndarray
    v: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``, by the sum-of-squares identity."""
        s = x @ self.v
        return sigmoid(x @ self.w + 0.5 * ((s * s).sum(1) - (x * x) @ (self.v * self.v).sum(1)))

    def score_sparse(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The same of rows given by places and values, in time linear in these."""
        if not rows:
            return np.zeros(0)
        at = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])[:-1]])
        places, values = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
        parts = self.v[places] * values[:, None]
        s = np.add.reduceat(parts, at, axis=0)
        z = np.add.reduceat(self.w[places] * values - 0.5 * (parts * parts).sum(1), at)
        return sigmoid(z + 0.5 * (s * s).sum(1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Machine:
    """Full-batch Adam on the logistic loss, classes weighing the same; deterministic.

    ``rows`` are places and values.  They are spread out ``BLOCK`` at a time, so
    that the driver never holds the sample as a dense matrix.
    """
    rng = np.random.default_rng(7)
    machine = Machine(np.zeros(WIDTH, dtype=np.float32), (0.01 * rng.standard_normal((WIDTH, RANK))).astype(np.float32))
    ones = int(y.sum())
    if not len(y) or ones in (0, len(y)):
        share = 0.5 if not len(y) else (ones + 0.5) / (len(y) + 1)
        machine.v[:] = 0
        machine.w[DIMENSIONS] = np.log(share / (1 - share))
        return machine
    weight = np.where(y > 0, 0.5 / ones, 0.5 / (len(y) - ones)).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (machine.w, machine.v)]
    x, squares = np.zeros((BLOCK, WIDTH), dtype=np.float32), np.zeros((BLOCK, WIDTH), dtype=np.float32)
    for t in range(1, rounds + 1):
        both, norms = np.column_stack([machine.w, machine.v]), (machine.v * machine.v).sum(1)
        slope, bend = np.zeros((WIDTH, RANK + 1), dtype=np.float32), np.zeros(WIDTH, dtype=np.float32)
        for at in range(0, len(y), BLOCK):
            block = rows[at : at + BLOCK]
            k = len(block)
            cells = np.concatenate([p for p, _ in block]) + np.repeat(np.arange(k) * WIDTH, [len(p) for p, _ in block])
            values = np.concatenate([v for _, v in block])
            x.ravel()[cells], squares.ravel()[cells] = values, values * values
            z = x[:k] @ both
            s = z[:, 1:]
            score = sigmoid(z[:, 0] + 0.5 * ((s * s).sum(1) - squares[:k] @ norms))
            d = ((score - y[at : at + k]) * weight[at : at + k]).astype(np.float32)
            slope += x[:k].T @ np.column_stack([d, s * d[:, None]])
            bend += squares[:k].T @ d
            x.ravel()[cells], squares.ravel()[cells] = 0, 0
        grads = (slope[:, 0] + decay * machine.w, slope[:, 1:] - machine.v * bend[:, None] + decay * machine.v)
        for p, g, (a, b) in zip((machine.w, machine.v), grads, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return machine


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a row belongs to the fold that is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    stated = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), stated.alias("stated"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Machine:
    """A machine fitted to at most ``per_class`` labelled rows of each class outside the held-out fold."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y", F.xxhash64("id").alias("h"))
    sample = usable.where("y = 0").orderBy("h", "id").limit(per_class).union(usable.where("y = 1").orderBy("h", "id").limit(per_class))
    rows = _inputs(docs, id_col, text_col, chars_col).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "text", "stated", "y")  # at most 2 * per_class ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_steps(batch, 200):
                xs = [features(raw, stated) for raw, stated in zip(utf8_arrays(part.column(1)), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3).cast(pa.int32()), pa.array([p.astype("<i2").tobytes() for p, _ in xs], pa.binary()), pa.array([v.tobytes() for _, v in xs], pa.binary())],
                    names=["doc_id", "y", "ix", "x"],
                )

    got = rows.mapInArrow(run, "doc_id long, y int, ix binary, x binary").toArrow().sort_by("doc_id")
    seen = np.unique(np.array(got["doc_id"]), return_index=True)[1] if got.num_rows else []
    got = got.take(pa.array(seen, pa.int64()))
    rows = [(np.frombuffer(p.as_buffer(), dtype="<i2"), np.frombuffer(v.as_buffer(), dtype=np.float32)) for p, v in zip(got["ix"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy().astype(np.float32))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; with ``carry`` its columns as ``doc`` instead of the id."""
    ship(docs.sparkSession)
    stated = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    own = F.struct("*") if carry else F.col(id_col).cast("long")
    kind = docs.schema.simpleString() if carry else "long"
    w, v = machine.w, machine.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(w, v)
        for batch in batches:
            for part in in_steps(batch, 500):
                xs = [features(raw, n) for raw, n in zip(utf8_arrays(part.column(1)), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score_sparse(xs), pa.float64())], names=["doc", "score"])

    out = docs.select(own.alias("doc"), F.col(text_col).cast("string").alias("text"), stated.alias("stated")).mapInArrow(run, f"doc {kind}, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    if carry:
        return out.select("doc", "score", predicted)
    return out.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "score", predicted)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Fit on ``labels``, score every document of ``docs``."""
    ship(docs.sparkSession)
    return score(docs, train(docs, labels, per_class, id_col, text_col, chars_col), threshold, id_col, text_col, chars_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are predicted to be good, in their own columns."""
    ship(docs.sparkSession)
    machine = train(docs, labels, PER_CLASS, id_col, text_col, chars_col)
    return score(docs, machine, threshold, id_col, text_col, chars_col, carry=True).where("predicted = 1").select("doc.*")
