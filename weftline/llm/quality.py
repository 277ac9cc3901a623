"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums are added in
two steps, so the driver gets a few matrices of a fixed size. Calibration pools adjacent violators over score bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import beside, listed, materialise, small_batches, text_batches, utf8, words
from weftline.llm.language import held_out

FEATURES = 256
RIDGE = 1.0
WIDTH = 3.0
BINS = 512

#: What is measured of each text, in order.
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "letters", "upper", "digits", "spaces", "sentence_marks", "other_punctuation", "symbols", "non_ascii",
    "line_bytes", "lines_repeated", "words_repeated", "pairs_repeated", "top_word", "long_words", "short_words", "capitalised", "symbol_ends", "bars", "words_a_mark",
)

_CLASS = np.zeros(256, np.int64)
for _name, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".?!", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|"), 1):
    _CLASS[list(_set)] = _name
_CLASS[128:] = 9


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; an empty one has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    hashes, bounds = words(texts)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text, np.uint8)
        n = len(raw)
        kinds = np.bincount(_CLASS[raw], minlength=10) / n
        own = hashes[bounds[i] : bounds[i + 1]]
        m = len(own)
        lines = [x for x in text.split(b"\n") if x.strip()]
        count = np.unique(own, return_counts=True)[1] if m else np.zeros(1)
        pairs = own[1:] * np.uint64(3) + own[:-1]
        tokens = text.split()
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
        first = np.fromiter((t[0] for t in tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
        last = np.fromiter((t[-1] for t in tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
        marks = kinds[5] * n
        out[i] = (
            np.log1p(n), np.log1p(m), n / max(m, 1), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[9],
            np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), 1 - len(count) / max(m, 1), 1 - len(np.unique(pairs)) / max(m - 1, 1) if m > 1 else 0, count.max() / max(m, 1),
            (sizes > 14).mean(), (sizes < 3).mean(), (_CLASS[first] == 2).mean(), (_CLASS[last] == 7).mean(), kinds[8], np.log1p(m / (marks + 1)),
        )
    return out


@dataclass
class Model:
    """Scores by random Fourier features; knots map a raw value to a calibrated one, constant beyond and linear between."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


_rng = np.random.default_rng(5)
_W = _rng.standard_normal((len(STATISTICS), FEATURES)) / WIDTH
_PHASE = _rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(z: np.ndarray) -> np.ndarray:
    """cos(Wz + b), scaled, with a constant and the inputs (cut at 8 deviations) beside."""
    z = np.clip(z, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ _W + _PHASE), z / 8, np.ones((len(z), 1))])


def _as_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    stats = np.frombuffer(b"".join(batch.column("stats").to_pylist()), float).reshape(-1, len(STATISTICS))
    return stats, batch.column("label").to_numpy().astype(float)


def _sums(arrays):
    """One row for each partition: the sum of what arrays makes of its batches."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = arrays(*_as_arrays(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _added(df: DataFrame, arrays, groups: int = 8) -> np.ndarray | None:
    """The sum over all partitions, first within groups of partitions."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column("part"):
                part = np.frombuffer(x.as_buffer(), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = df.mapInArrow(_sums(arrays), "part binary").repartition(groups).mapInArrow(add, "part binary").collect()
    return sum(np.frombuffer(r["part"], float) for r in parts) if parts else None


def isotonic(x: np.ndarray, positives: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: values x (ascending) and their rising share of positives."""
    blocks: list[list[float]] = []
    for xi, p, w in zip(x, positives, n, strict=True):
        blocks.append([xi * w, p, w, xi, xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3], b[4]]
    return np.array([v for b in blocks for v in (b[3], b[4] + 1e-9)]), np.array([b[1] / b[2] for b in blocks for _ in (0, 1)])


def train(stats: DataFrame, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """Learn from all rows (stats binary, label 0 or 1, fold): no sample is taken, as only sums are gathered.

    Calibration uses scores by a fit on the other fold of two, in ``bins`` equal bins. Without rows every score is 0.5.
    """
    d = len(STATISTICS)
    size = FEATURES + d + 1
    none = Model(np.zeros(d), np.ones(d), np.zeros(size), (np.array([0.0]), np.array([0.5])))
    moments = _added(stats, lambda s, y: np.vstack([s, s**2]).reshape(2, -1, d).sum(axis=1).ravel() if len(s) else np.zeros(2 * d))
    if moments is None:
        return none
    n = stats.count()
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d:] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0

    def normal(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = fourier((s - mean) / scale)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y, [len(y)]])

    halves = [_added(stats.filter(F.col("fold") == k), normal) for k in (0, 1)]
    halves = [np.zeros(size * size + size + 1) if h is None else h for h in halves]

    def solve(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[: size * size].reshape(size, size) + ridge * np.eye(size), sums[size * size : -1])

    whole, other = solve(halves[0] + halves[1]), [solve(halves[1]), solve(halves[0])]
    edges = np.linspace(-0.5, 1.5, bins + 1)
    counts = np.zeros((2, bins))
    for k in (0, 1):

        def binned(s: np.ndarray, y: np.ndarray, w=other[k]) -> np.ndarray:
            at = np.clip(np.searchsorted(edges, fourier((s - mean) / scale) @ w) - 1, 0, bins - 1)
            return np.concatenate([np.bincount(at, y, bins), np.bincount(at, minlength=bins)])

        if (got := _added(stats.filter(F.col("fold") == k), binned)) is not None:
            counts += got.reshape(2, bins)
    used = counts[1] > 0
    middle = (edges[:-1] + edges[1:]) / 2
    return Model(mean, scale, whole, isotonic(middle[used], counts[0][used], counts[1][used]))


def measured(docs: DataFrame) -> DataFrame:
    """The other columns of docs, with the text's statistics as packed doubles; a column of that name (stats) goes. No rows give none."""
    small_batches(docs.sparkSession)
    rest = beside(docs, "text", "stats")

    def run(batches):
        for batch in text_batches(batches):
            rows = statistics(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array([r.tobytes() for r in rows], pa.binary())], names=[*[f.name for f in rest], "stats"])

    return docs.select(*[f.name for f in rest], "text").mapInArrow(run, f"{listed(rest)}stats binary")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) to rows with stats; the statistics go, other columns stay but one of the result's name."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    rest = beside(stats, "stats", "score")

    def run(batches):
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("stats").to_pylist()), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(shared.value.score(s))], names=[*[f.name for f in rest], "score"])

    return stats.select(*[f.name for f in rest], "stats").mapInArrow(run, f"{listed(rest)}score double")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: quality of every whole text of documents, learned from labels where crc32(doc_id) modulo 5 isn't 0.

    Null and empty texts have statistics of 0 and are scored like others. Null labels are left out; a repeated label counts
    again. Documents are joined to labels by id, never by text; repeated rows give repeated results.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    stats = materialise(measured(docs), "statistics")
    known = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    learned = materialise(stats.join(known, "doc_id").select("stats", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")), "labelled")
    found = score(stats, train(learned))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
