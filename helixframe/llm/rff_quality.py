"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes some twenty statistics.  Standardised, they go through
cos(x W + b) with Gaussian W, whose products approximate a Gaussian kernel.
Tasks add up Z'Z and Z'y of their labelled rows, one pair a fold; Spark adds
those up in two rounds, so the driver gets `WIDE` sums at most.  Taking a fold's
sums from all sums gives the equations of the other folds: the ridge strength
is the one with the least squared error out of fold, and isotonic calibration
is fitted on out-of-fold scores, all labelled rows of them, in fixed bins.

All labelled rows outside the held-out fifth are learnt from.  Ids only say
which fold a row is in; labels, languages and sources are never inputs.

Defined results: null text is scored as an empty one; repeated rows each get
the same score; several labels of an id count as their mean, ids without a
document and null ids or labels as none; a null id is held out; where the
labels are none or all alike, every score is their mean (none: 0.5); an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.util import stored, texts_of

FOLDS = 5
#: Random features, the kernel's width against the standardised statistics, and the seed of both.
FEATURES, WIDTH, SEED = 256, 3.0, 12
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
#: Sums that the last round hands to the driver, and how many times as many the first round makes.
WIDE, FAN = 8, 16
#: Bins of the calibration, over raw scores from LOW to HIGH.
BINS, LOW, HIGH = 2000, -0.5, 1.5
THRESHOLD = 0.3
STATS = (
    "log_chars log_words log_lines chars_a_word symbols upper digits pipes marks ends spaces wide entropy distinct top_word "
    "same_neighbours dup_lines words_a_line short_words long_words"
).split()


def _classes() -> np.ndarray:
    """A column for each class of bytes: symbols, upper case, digits, pipes, other marks, sentence ends, spaces, bytes of wide characters."""
    kinds = [b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b"|", b"!\"'()+-/:;=?@[\\]^_`{}~", b".,", b" \t\n\v\f\r", bytes(range(128, 256))]
    table = np.zeros((256, len(kinds)))
    for i, k in enumerate(kinds):
        table[list(k), i] = 1
    return table


_CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATS; finite for every text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    shares = counts[counts > 0] / n
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), math.log1p(float(sizes.sum()) / w),
        *(counts @ _CLASSES / n).tolist(),
        float(-(shares * np.log2(shares)).sum()) if len(raw) else 0.0,
        len(seen) / w ** 0.9, (max(seen.values()) if seen else 0) / w, sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / m if lines else 0.0, math.log1p(len(words) / m),
        float((sizes <= 2).sum()) / w, float((sizes > 20).sum()) / w,
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of double, as STATS) of each whole text; narrow."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(measured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def matrix(column: pa.ListArray, width: int = len(STATS)) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (fold, part, sums: doubles as binary) by fold: over parts in two rounds of Spark, then over at most WIDE parts here."""

    def added(key, group):
        total = sum(np.frombuffer(x.as_buffer()) for x in group["sums"])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["fold", "part", "sums"])

    for parts in (WIDE * FAN, WIDE):
        rows = rows.withColumn("part", F.col("part") % parts).groupBy("fold", "part").applyInArrow(added, "fold int, part int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        part = np.frombuffer(bytes(r["sums"]))
        out[r["fold"]] = out[r["fold"]] + part if r["fold"] in out else part
    return out


def partial_sums(rows: DataFrame, features, width: int) -> DataFrame:
    """For each task and fold of (fold, x, y): features(x) beside y as one matrix M, and M'M, as (fold, part, sums)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, y = np.asarray(b.column(0)), np.asarray(b.column(2))
            for i in range(0, len(fold), 1024):
                m = np.column_stack([features(matrix(b.column(1)[i : i + 1024])), y[i : i + 1024]])
                for k in np.unique(fold[i : i + 1024]).tolist():
                    own = m[fold[i : i + 1024] == k]
                    sums[k] = sums.get(k, 0.0) + own.T @ own
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fold", "part", "sums"])

    return rows.select("fold", "x", "y").mapInArrow(added, "fold int, part int, sums binary")


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y in weighted squares."""
    blocks: list[list[float]] = []  # mean, weight, entries
    for v, w in zip(y.tolist(), weight.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


@dataclass(frozen=True)
class Model:
    """A fitted scorer: a few thousand numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.waves + self.phases) * math.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher: a label 1 is likelier."""
        if not len(self.weights):
            return np.full(len(x), self.calibrated[0])
        return np.interp(self.features(x) @ self.weights, self.raw, self.calibrated)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES, seed: int = SEED) -> Model:
    """A model from the labelled rows of document_statistics() outside the held-out fold; stats should be stored, as it is read three times."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = stored(stats.withColumn("fold", fold_of("doc_id")).filter("fold > 0").join(known, "doc_id").select("fold", "x", "y"), "labelled")
    plain = summed(partial_sums(rows, lambda x: np.column_stack([x, np.ones(len(x))]), len(STATS) + 1))
    k = len(STATS)
    none = np.zeros(0)
    if not plain:
        return Model(none, none, none, none, none, none, np.array([0.5]))
    total = sum(plain.values()).reshape(k + 2, k + 2)
    n, base = total[k, k], total[k, k + 1] / total[k, k]
    if np.isclose(total[k + 1, k + 1] / n, base**2):  # all labels alike
        return Model(none, none, none, none, none, none, np.array([base]))
    mean = total[k, :k] / n
    spread = np.sqrt(np.maximum(np.diag(total)[:k] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    start = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.standard_normal((k, features)) / WIDTH, rng.uniform(0, 2 * math.pi, features), none, none, none)
    sums = {f: s.reshape(features + 2, features + 2) for f, s in summed(partial_sums(rows, start.features, features + 1)).items()}
    ridge = min(RIDGES, key=lambda r: sum(_squares(_solved(sums, f, r), s) for f, s in sums.items()))
    apart = {f: _solved(sums, f, ridge) for f in sums}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = start.features(matrix(b.column(1))), np.asarray(b.column(0))
            raw = (z * np.array([apart[f] for f in fold.tolist()])).sum(axis=1) if len(fold) else np.zeros(0)
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), b.column(2)], ["bin", "raw", "y"])

    bins = rows.select("fold", "x", "y").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    return Model(start.mean, start.scale, start.waves, start.phases, _solved(sums, None, ridge), bins["raw"].to_numpy(), pool_adjacent(bins["y"].to_numpy(), bins["n"].to_numpy()))


def _solved(sums: dict[int, np.ndarray], without: int | None, ridge: float) -> np.ndarray:
    """Ridge weights from the sums of all folds but one."""
    m = sum(s for f, s in sums.items() if f != without or len(sums) == 1)
    size = len(m) - 1
    return np.linalg.solve(m[:size, :size] + ridge * np.eye(size), m[:size, size])


def _squares(w: np.ndarray, m: np.ndarray) -> float:
    """Squared error of weights on the rows behind the sums m."""
    return float(m[-1, -1] - 2 * w @ m[:-1, -1] + w @ m[:-1, :-1] @ w)


def fold_of(id_col: str):
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of document_statistics(); narrow."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.concatenate([np.zeros(0), *(model.score(matrix(b.column(2)[i : i + 1024])) for i in range(0, b.num_rows, 1024))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = stats.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "x")
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled rows of docs and score all of them; texts are read once, their statistics stored."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    return score(stats, fit(stats, labels, id_col, label_col), threshold)
