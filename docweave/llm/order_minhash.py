"""Document fingerprints by Order MinHash.

The k-mers (k code points) of a text are numbered by occurrence and dealt by one hash to SLOTS slots. In
each slot the TUPLE least are chosen, put in text order, and their tuple is hashed. Two texts agree in
a slot only if they share these k-mers in the same order, so the share of slots in which they agree
follows their edit distance, not only what they have in common.

Cases: a null text counts as empty; a text of fewer than k code points is one k-mer; the fingerprint of
an empty text is empty slots, alike (1) to itself alone; equal texts have equal fingerprints wherever
and with whatever they are computed; repeated rows and further columns change nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 8
SLOTS = 64
TUPLE = 2
#: A call of fingerprints() sees fewer code points than this, but for a longer single text.
POSITIONS = 1 << 21
#: Values that a slot of a long text is expected to get at first; with so many, few texts need a second look.
ENOUGH = 12
BASE = np.uint64(0x9E3779B97F4A7C15)
ROUND1, ROUND2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * ROUND1
    x ^= x >> np.uint64(33)
    x = x * ROUND2
    return x ^ (x >> np.uint64(33))


def kmers(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text numbers and places of the k-mers of concatenated texts."""
    h = codes.astype(np.uint64) + np.uint64(1)
    whole, n, base = None, 0, int(BASE)  # whole: hashes of the n code points that follow; h: of a power of two of them
    width = 1
    while True:
        if k & width:
            if whole is None:
                whole, n = h.copy(), width
            else:  # the wider part goes in front
                m = max(0, len(h) - width)
                front = h.copy()
                front[:m] = h[:m] * np.uint64(pow(base, n, 1 << 64)) + whole[width : width + m]
                whole, n = front, n + width
        width *= 2
        if width > k:
            break
        m = max(0, len(h) - width // 2)
        up = h[:m] * np.uint64(pow(base, width // 2, 1 << 64)) + h[width // 2 :][:m]
        h = np.concatenate([up, h[m:]])
    h = whole
    count = np.where(sizes >= k, sizes - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    hashes = h[place]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = []
        for s in short.tolist():
            v = 0
            for x in codes[starts[s] : starts[s] + sizes[s]].tolist():
                v = (v * int(BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
            extra.append(v)
        owner, place, hashes = np.concatenate([owner, short]), np.concatenate([place, starts[short]]), np.concatenate([hashes, np.array(extra, np.uint64)])
        order = np.argsort(place, kind="stable")
        owner, place, hashes = owner[order], place[order], hashes[order]
    return mix(hashes), owner, place


def fingerprints(texts: list[str], k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE) -> np.ndarray:
    """A row of uint32 slots for each text; 0: empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), slots), np.uint32)
    if not sizes.sum():
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, owner, _ = kmers(codes, np.cumsum(sizes) - sizes, sizes, k)
    # Occurrences: sorting hash and place in one number leaves equal k-mers of a text in text order.
    bits = np.uint64(max(1, int(len(hashes) - 1).bit_length()))
    local = hashes + mix(owner.astype(np.uint64) + np.uint64(1))  # equal k-mers of different texts lie apart
    packed = np.sort((local >> bits << bits) | np.arange(len(hashes), dtype=np.uint64))
    again = np.flatnonzero((packed[1:] ^ packed[:-1]) >> bits == 0) + 1
    seeds = hashes
    if len(again):
        run = np.ones(len(again), np.int64)  # 1, 2, ... within each run of equal ones
        starts = np.flatnonzero(np.concatenate([[True], np.diff(again) != 1]))
        run = np.arange(len(again)) - np.repeat(starts, np.diff(np.append(starts, len(again)))) + 1
        seeds = hashes.copy()
        seeds[(packed[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] += run.astype(np.uint64) * BASE
    order_by = mix(seeds)
    # Of a long text only small values can be among the least of their slot; where they don't fill a slot, all are taken.
    counts = np.bincount(owner, minlength=len(texts))
    most = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    long_ = counts > ENOUGH * slots
    most[long_] = (ENOUGH * slots / counts[long_] * 2.0**64).astype(np.uint64)
    value = order_by >> np.uint64(20)  # 44 bits, whatever the number of texts
    at = np.flatnonzero(value <= (most >> np.uint64(20))[owner]) if long_.any() else np.arange(len(owner))
    slot = owner[at] * slots + (order_by[at] % np.uint64(slots)).astype(np.int64)
    filled = np.bincount(slot, minlength=len(texts) * slots).reshape(len(texts), slots)
    poor = np.flatnonzero(long_ & (filled < tuple_size).any(axis=1))
    if len(poor):
        short = np.zeros(len(texts), bool)
        short[poor] = True
        at = np.flatnonzero((value <= (most >> np.uint64(20))[owner]) | short[owner])
        slot = owner[at] * slots + (order_by[at] % np.uint64(slots)).astype(np.int64)
    # The least of each slot: by slot, then by value, in one number (room for 4096 texts of 256 slots).
    least = np.argsort((slot.astype(np.uint64) << np.uint64(44)) | value[at], kind="stable")
    slot, at = slot[least], at[least]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
    chosen, slot = at[rank < tuple_size], slot[rank < tuple_size]
    again = np.lexsort((chosen, slot))  # text order within the slot
    chosen, slot = chosen[again], slot[again]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    n = np.diff(np.append(first, len(slot)))
    tuples = np.zeros(len(first), np.uint64)
    for j in range(tuple_size):
        has = n > j
        tuples[has] = mix(tuples[has] * BASE + order_by[chosen[first[has] + j]] + np.uint64(j + 1))
    out.reshape(-1)[slot[first]] = np.maximum(tuples >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of slots: the share, of slots that either fills, in which both agree; 1 for two empty texts."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(filled, same / np.maximum(filled, 1), 1.0)


def groups(texts: list[str], most: int = POSITIONS):
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > most or i - start >= 4096):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def in_groups(texts: list[str], **parameters) -> np.ndarray:
    parts = [fingerprints(texts[a:b], **parameters) for a, b in groups(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, parameters.get("slots", SLOTS)), np.uint32)


def written(slots: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in slots.astype(">u4")]


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE) -> DataFrame:
    """docs with fingerprint string (hex; a column of that name is replaced). No shuffle."""
    docs = docs.drop("fingerprint")
    schema = docs.withColumn("fingerprint", F.lit("")).schema

    def run(batches):
        for batch in common.slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = in_groups(texts, k=k, slots=slots, tuple_size=tuple_size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(written(found), pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, text) in partitions sorted so that each document is followed by the next lower doc_id.

    Bounds at quantiles of doc_id deal the rows to buckets; the first document of a bucket is also the
    last of the bucket before, as a guest, and the highest doc_id is the guest of the last bucket. One
    shuffle of the texts; the driver gets the bounds alone, a number for each bucket.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n + 1)]).alias("q"), F.max("doc_id").alias("most")).first()
    bounds = np.array(sorted({*(found.q or []), found.most} - {None}) or [0], np.int64)  # ascending; each is some document's id
    last = len(bounds) - 1

    @F.pandas_udf("array<long>")
    def targets(ids: pd.Series) -> pd.Series:
        """2 x bucket (0: the highest ids), and 2 x bucket + 1 where the document is a guest."""
        known = ids.fillna(bounds[0]).to_numpy(np.int64)
        at = np.searchsorted(bounds, known)  # bounds[at - 1] < id <= bounds[at]
        bucket = last - at
        guest = (bounds[at] == known) & ids.notna().to_numpy()
        return pd.Series([[2 * b, 2 * ((b - 1) % (last + 1)) + 1] if g else [2 * b] for b, g in zip(bucket.tolist(), guest.tolist(), strict=True)])

    dealt = docs.withColumn("target", F.explode(targets("doc_id")))
    dealt = dealt.select(F.floor(F.col("target") / 2).alias("bucket"), (F.col("target") % 2).alias("guest"), "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its later half replaced by the next document's beginning)."""

    def run(batches):
        def flush(rows: list, over: bool):
            """rows: (bucket, guest, doc_id, text); the last one waits for its next unless all is over."""
            texts = [r[3] for r in rows]
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1]]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in pairs]
            own, other = in_groups(texts), in_groups(edited)
            at, after = [i for i, _ in pairs], [j for _, j in pairs]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in at], pa.int64()),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(written(own[at]), pa.string()),
                    pa.array(written(other), pa.string()),
                    pa.array(likeness(own[at], other), pa.float64()),
                    pa.array(likeness(own[at], own[after]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        waiting: list = []
        for batch in common.slices(batches, "text"):
            waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            # Of several guests (rows of one doc_id) the first counts; what follows it in its bucket is dropped.
            kept = [r for i, r in enumerate(waiting) if not (r[1] and i and waiting[i - 1][1] and waiting[i - 1][0] == r[0])]
            yield flush(kept, False)
            waiting = kept[-1:]

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(common.table(spark, sf_dir, "documents"))
