"""A quality score: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The random features cos(w x + b) approximate a Gaussian kernel. Each partition sums its share of the normal equations;
the sums are added up in Spark, and the driver solves one system whose size is the number of features.
"""
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refreshgate.llm.batches import id_and_text, map_batches, text_slices
from refreshgate.session import cut_lineage

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "blanks", "line_feeds", "punctuation", "symbols", "bars",
              "exclamations", "beyond_ascii", "distinct", "echoes", "top_word", "repeated_lines", "line_words")
CLIP = 5.0
BINS = 2000
RAW_RANGE = (-1.0, 2.0)


@dataclass
class QualityModel:
    """Statistics are centred and scaled, mapped by `directions` and `phases`, weighed, and calibrated by `steps`."""
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]


def statistics_of(text: str) -> list[float]:
    raw = text.encode()
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    letters = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    plain = sum(map(raw.count, (b".", b",", b";", b":", b"'", b'"', b"(", b")", b"-", b"?")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
    return [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / m, (len(raw) - len(letters)) / n,
            (len(raw) - len(raw.translate(None, b"0123456789"))) / n, raw.count(b" ") / n, raw.count(b"\n") / n, plain / n,
            symbols / n, raw.count(b"|") / n, raw.count(b"!") / n, (len(raw) - len(text)) / n, len(set(words)) / m,
            sum(map(eq, words, words[1:])) / m, (Counter(words).most_common(1)[0][1] if words else 0) / m,
            1 - len(set(lines)) / len(lines), np.log1p(len(words) / len(lines))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the whole text of every row; a NULL text is an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                made = [statistics_of(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_batches(id_and_text(docs), run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def _features(model: QualityModel, x: np.ndarray) -> np.ndarray:
    scaled = np.clip((x - model.centre) / model.scale, -CLIP, CLIP)
    waves = np.sqrt(2 / len(model.phases)) * np.cos(scaled @ model.directions + model.phases)
    return np.hstack((np.ones((len(x), 1)), waves))


def _calibrated(model: QualityModel, raw: np.ndarray) -> np.ndarray:
    at, value = model.steps
    return np.clip(np.interp(raw, at, value), 0, 1) if len(at) else np.full(len(raw), 0.5)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: centres and means of the pooled blocks."""
    blocks: list[list[float]] = []
    for place, positive, count in zip(at, ones, n):
        blocks.append([place * count, positive, count])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(statistics: DataFrame, labels: DataFrame, features: int = 256, bandwidth: float = 4.0, ridge: float = 1e-3,
        partitions: int = 64, seed: int = 7) -> QualityModel:
    """Fit on every row of `labels` (doc_id, label 0/1, both not NULL) that has statistics; repeated rows count each.

    The labelled rows are dealt to `partitions` tasks, each of which sends one sum of features x features numbers. The
    driver receives their total, the means, and BINS counts for the calibration. Without labels every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    model = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + 1), (np.zeros(0), np.zeros(0)))
    rows = cut_lineage(statistics.join(labels.where("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "label"), "doc_id")
                       .select("x", F.col("label").cast("double").alias("y")).repartition(partitions))
    moments = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[k]).alias(f"{f.__name__}_{k}") for f in (F.avg, F.stddev_pop)
                                                  for k in range(d)]).first()
    if not moments["n"]:
        return model
    model.centre = np.array([moments[f"avg_{k}"] for k in range(d)])
    model.scale = np.array([moments[f"stddev_pop_{k}"] for k in range(d)])
    model.scale[model.scale < 1e-9] = 1.0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = _features(model, _matrix(batch.column("x")))
            total += z.T @ np.hstack((z, batch.column("y").to_numpy()[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["row", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = np.stack(table.column("sums").to_pylist()).sum(0)
        return pa.table({"row": table.column("row").slice(0, 1).cast(pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "row int, sums array<double>"
    summed = map_batches(rows, equations, schema).groupBy("row").applyInArrow(added, schema).orderBy("row").collect()
    system = np.array([r["sums"] for r in summed])
    model.weights = np.linalg.solve(system[:, :-1] + ridge * moments["n"] * np.eye(features + 1), system[:, -1])
    low, high = RAW_RANGE

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(_features(model, _matrix(batch.column("x"))) @ model.weights, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(((raw - low) / (high - low) * (BINS - 1)).astype(np.int32)), batch.column("y")],
                                             ["bin", "y"])

    counts = map_batches(rows, binned, "bin int, y double").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    at = np.array([low + (r["bin"] + 0.5) / (BINS - 1) * (high - low) for r in counts])
    model.steps = isotonic(at, np.array([r["ones"] for r in counts]), np.array([r["n"] for r in counts]))
    return model


def score(statistics: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row of `statistics`."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            raw = _features(own, _matrix(batch.column("x"))) @ own.weights
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_calibrated(own, raw))], ["doc_id", "score"])

    return map_batches(statistics, run, "doc_id long, score double")
