"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes statistics of itself (letters, signs, words, lines); random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each partition sums its part of the normal
equations, the sums are added up in Spark, and the driver solves one small system. A part of the labelled
rows that the fit doesn't see calibrates the scores by isotonic regression.

The fit takes at most MOST_ROWS labelled rows, chosen by hash of doc_id; scoring takes all rows.

Cases: a null text counts as empty and has a score like any other; without labelled rows of both kinds
every score is the share of label 1 (0.5 without labels); null labels are not learnt from; of several
labels of one doc_id each counts; labels never enter a score, nor do further columns.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_ROWS = 40_000
FEATURES = 256
RIDGE = 1e-3
#: Width of the kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 1.5
SEED = 11
#: Of ten parts of the labelled rows, so many calibrate.
CALIBRATE = 3
END = re.compile(r"[.!?…](?:\s|$)")

LOWER, UPPER, DIGIT, BLANK, HIGH = (np.zeros(256) for _ in range(5))
LOWER[97:123], UPPER[65:91], DIGIT[48:58], HIGH[128:] = 1, 1, 1, 1
BLANK[[9, 10, 11, 12, 13, 32]] = 1
STOP, COMMA = np.zeros(256), np.zeros(256)
STOP[[ord(c) for c in ".!?"]] = 1
COMMA[[ord(c) for c in ",;:'\"()-"]] = 1
SIGN = 1 - np.maximum.reduce([LOWER, UPPER, DIGIT, BLANK, HIGH, STOP, COMMA])
KINDS = np.stack([LOWER, UPPER, DIGIT, BLANK, HIGH, STOP, COMMA, SIGN], axis=1)
N_STATISTICS = 22


def statistics(text: str | None) -> np.ndarray:
    """Of the whole text; the same number for every text, zeros for an empty one."""
    out = np.zeros(N_STATISTICS)
    raw = (text or "").encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n = max(1, len(words))
    out[:8] = share @ KINDS
    out[8] = np.log1p(len(raw))
    out[9] = np.log1p(len(words))
    out[10] = np.log1p(len(raw) / n)
    distinct = set(words)
    out[11] = len(distinct) / n
    out[12] = len(distinct) / n**0.5
    out[13] = len(set(lines)) / max(1, len(lines))
    out[14] = np.log1p(len(raw) / max(1, len(lines)))
    out[15] = len(END.findall(text)) / n
    out[16] = -(share[share > 0] * np.log(share[share > 0])).sum()
    out[17] = sum(map(str.isupper, words)) / n
    out[18] = sum(map(str.isalpha, words)) / n
    pairs = set(zip(words, words[1:], strict=False))
    out[19] = len(pairs) / max(1, len(words) - 1)
    out[20] = len({w.lower() for w in distinct}) / max(1, len(distinct))
    longest = max(map(len, words), default=0)
    out[21] = np.log1p(longest)
    return out


class Model:
    """Standardisation, random features, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, share):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.share = mean, scale, share
        self.directions = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * len(mean) ** 0.5)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.raw, self.calibrated = np.zeros(1), np.full(1, share)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * (2 / FEATURES) ** 0.5, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.raw, self.calibrated), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares rising fit of y over x, as knots (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least x, most x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, most = blocks.pop()
            p = blocks[-1]
            p[0] = (p[0] * p[1] + m * w) / (p[1] + w)
            p[1], p[3] = p[1] + w, most
    knots = [(e, b[0]) for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def fit(rows: DataFrame) -> Model:
    """rows: text, label (0 or 1), calibrates boolean; a bounded number of them."""

    def measured(batches):
        for batch in common.slices(batches, "text"):
            x = np.stack([statistics(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "calibrates"])

    table = common.materialise(rows.select("text", F.col("label").cast("double").alias("label"), "calibrates").mapInArrow(measured, "x array<double>, label double, calibrates boolean"), "statistics")

    def summed(df: DataFrame, part) -> list[np.ndarray]:
        """part(x, y) gives arrays for some rows; their sums over all rows, added up in Spark by place."""

        def partial(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    now = part(np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy())
                    total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
            for i, a in enumerate(total or []):
                for j, row in enumerate(np.atleast_2d(a)):
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "row": pa.array([row], pa.list_(pa.float64()))})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": pdf["i"][:1], "j": pdf["j"][:1], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})

        got = df.select("x", "label").mapInArrow(partial, "i int, j int, row array<double>").groupBy("i", "j").applyInPandas(add, "i int, j int, row array<double>").collect()
        arrays: dict[int, dict[int, list]] = {}
        for r in got:
            arrays.setdefault(r.i, {})[r.j] = r.row
        return [np.array([arrays[i][j] for j in sorted(arrays[i])]) for i in sorted(arrays)]

    sums = summed(table, lambda x, y: [np.array([[len(x), y.sum()]]), x.sum(0), (x * x).sum(0)])
    if not sums:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), 0.5)
    (n, ones), mean, square = sums[0][0], sums[1][0] / sums[0][0][0], sums[2][0] / sums[0][0][0]
    model = Model(mean, np.sqrt(np.maximum(square - mean**2, 1e-8)), ones / n)
    if not 0 < ones < n:
        return model
    gram = summed(table.where("not calibrates"), lambda x, y: (lambda f: [f.T @ f, f.T @ y])(model.features(x)))
    if not gram:
        return model
    a, b = gram[0], gram[1][0]
    model.weights = np.linalg.solve(a + RIDGE * n / FEATURES * np.eye(len(a)), b)
    held = table.where("calibrates").select("x", "label").collect()  # a share of MOST_ROWS rows
    if len({r.label for r in held}) == 2:
        raw = model.features(np.array([r.x for r in held])) @ model.weights
        model.raw, model.calibrated = isotonic(raw, np.array([r.label for r in held]))
    else:
        model.raw, model.calibrated = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learns: Column | None = None, most: int = MOST_ROWS) -> Model:
    """Learns from the rows of labels (doc_id, label) for which `learns` (of doc_id) holds, `most` at most."""
    usable = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if learns is not None:
        usable = usable.where(learns)
    share = max(1, -(-usable.count() * 11 // (10 * most)))  # leaves room for uneven hashes
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < CALIBRATE)
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "calibrates"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double (a column of that name is replaced). No shuffle; the model is a few hundred KB."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        common.make_room()
        for batch in common.slices(batches, "text"):
            x = np.stack([statistics(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc(F.col("doc_id")) % 3 == 1
    model = train(docs, labels, learns=~held_out)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
