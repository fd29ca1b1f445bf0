"""Language ID: a byte convolutional network over fixed-length windows, trained in numpy.

Bytes fall into classes (letters regardless of case, each byte beyond ASCII, everything else as one), a
class has a small vector, filters of several widths run over a window, their greatest responses go
through one softmax layer. A whole text is cut into windows; their logits are averaged, weighted by letters.

For use the trained filters are folded into tables over pairs of classes: a filter of width w is a sum of
ceil(w / 2) table rows, so a window costs look-ups instead of products, with the same results.

Training takes at most MOST_DOCS labelled texts, chosen by hash of doc_id, and TRAIN_WINDOWS windows of
each, spread over the text; prediction takes every window of every text.

Cases: `und` with score 0 for null texts and texts without a letter, and for all texts if there is
nothing to learn from; null languages are not learnt from; further columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import crc

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
VECTOR = 8
MOST_DOCS = 3000
TRAIN_WINDOWS = 3
EPOCHS = 6
#: Small samples are gone over more often, for so many steps at least.
LEAST_STEPS = 250
BATCH = 128
RATE = 4e-3
SEED = 7
UNDETERMINED = "und"
#: The pipeline rejects what is less certain than this: where the best language is less likely than all others together.
#: Of 2499 held-out documents (sf0.1) 5 lie below, 4 of them (repeats of one word, a line of names) are taken for another language.
CERTAIN = 0.5

#: The class of each byte: 0 neither letter nor beyond ASCII, 1-26 letters, then each byte from 0x80.
CLASS = np.zeros(256, np.int64)
CLASS[65:91] = CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
CLASSES = 155


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all windows (rows of WINDOW, filled up with 0) and the text that each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros(len(owner) * WINDOW, np.int64)
    first = (np.cumsum(count) - count) * WINDOW
    raw = np.frombuffer(b"".join(texts), np.uint8)
    to = np.arange(len(raw)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    out[to] = CLASS[raw]
    return out.reshape(-1, WINDOW), owner


class Network:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.p = {"v": rng.normal(0, 0.5, (CLASSES, VECTOR)), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "c": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * VECTOR)) ** 0.5, (w * VECTOR, FILTERS))
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.tables: dict = {}

    def forward(self, x: np.ndarray):
        e = self.p["v"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            r = cols.reshape(-1, w * VECTOR) @ self.p[f"f{w}"]
            r = r.reshape(len(x), n, FILTERS)
            at = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
            kept.append(at)
        h = np.concatenate(pooled, axis=1)
        return e, kept, h, np.maximum(h, 0) @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        e, kept, h, z = self.forward(x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"o": np.maximum(h, 0).T @ p, "c": p.sum(0), "v": np.zeros_like(self.p["v"])}
        dh = (p @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            d, at = dh[:, i * FILTERS : (i + 1) * FILTERS], kept[i]
            f = self.p[f"f{w}"].reshape(w, VECTOR, FILTERS)
            gf = np.zeros_like(f)
            for j in range(w):
                gf[j] = np.einsum("bfv,bf->vf", e[rows, at + j], d)
                np.add.at(g["v"], x[rows, at + j].ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, VECTOR))
            g[f"f{w}"] = gf.reshape(w * VECTOR, FILTERS)
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        s = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                at = order[a : a + BATCH]
                step += 1
                for k, g in self.gradients(x[at], y[at]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.fold()

    def fold(self) -> None:
        """Tables over pairs of classes (and single ones for the last place of odd widths)."""
        for w in WIDTHS:
            f = self.p[f"f{w}"].reshape(w, VECTOR, FILTERS)
            one = [self.p["v"] @ f[j] for j in range(w)]
            self.tables[w] = [(j, (one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS)) if j + 1 < w else (j, one[j]) for j in range(0, w, 2)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            r = None
            for j, t in self.tables[w]:
                part = t.take((pair if len(t) > CLASSES else x)[:, j : j + n].ravel(), axis=0)
                r = part if r is None else np.add(r, part, out=r)
            pooled.append(r.reshape(len(x), n, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["o"] + self.p["c"]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        if not known:
            return names, scores
        x, owner = windows([texts[i].encode() for i in known])
        z = np.concatenate([self.logits(x[a : a + 512]) for a in range(0, len(x), 512)])
        weight = (x > 0).sum(axis=1) + 1e-3
        total = np.zeros((len(known), len(self.languages)))
        np.add.at(total, owner, z * weight[:, None])
        total /= np.bincount(owner, weight, len(known))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, i in enumerate(known):
            names[i], scores[i] = self.languages[best[k]], p[k, best[k]]
        return names, scores


def train(docs: DataFrame, learns: Column | None = None, most: int = MOST_DOCS) -> Network:
    """Learns from text and lang of the rows for which `learns` holds, `most` at most; they go to the driver."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    if learns is not None:
        usable = usable.where(learns)
    share = max(1, -(-usable.select("lang").count() * 11 // (10 * most)))
    n = F.length("text")
    # Windows of at most 64 code points less than bytes may overlap; a window starts at each of TRAIN_WINDOWS even places.
    cut = F.array(*(F.substring(F.col("text"), (n * i / TRAIN_WINDOWS).cast("int") + 1, F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("doc_id", "lang", F.explode(F.array_distinct(cut)).alias("t"))
    rows = sorted((r.doc_id or 0, r.lang, r.t) for r in chosen.collect())
    rows = [r for r in rows if any(map(str.isalpha, r[2]))]
    languages = sorted({r[1] for r in rows})
    net = Network(languages)
    if rows:
        x, owner = windows([r[2].encode()[:WINDOW] for r in rows])
        y = np.array([languages.index(r[1]) for r in rows])[owner]
        net.train(x, y)
    return net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """docs with lang_pred string and lang_score double (columns of these names are replaced). No shuffle; the network is a few MB."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema

    def run(batches):
        common.make_room()
        for batch in common.slices(batches, "text", 1 << 20):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = crc(F.col("doc_id")) % 4 == 2
    net = train(docs, ~held_out)
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
