"""MinHash near-dedup with bottom-k sketches from one hash function.

Each text's set of word shingles keeps its k least hashes. Texts of one set are a class. Inverted lists
of retained values propose pairs of classes; how much the two sketches share among the k least of their
union estimates the Jaccard index and filters; the index of the full sets decides.

No group's pairs are enumerated. Of a sketch the commonest values are left out as far as a pair of the
wanted similarity must still share a rarer one. In a list, every class is first compared with one hub,
the class whose values are shared most; classes linked with the hub are then one. Classes of lists that still
hold several components get larger sketches and new lists, whose entries say where a pair would meet and
so whether enough is left for the wanted similarity. Short lists (FEW entries) are compared directly. Of a
longer list only differences from its hub are compared: two classes of which one is not linked with the hub
can only be alike if they differ from it in common ways. So each class keeps its rarest differences, as many as
a partner can't all lack, and meets only those that share one of them. This loses no pair: it is the same rule
as for the sketches, on exact sets.

Shingles are known by 64-bit hashes, sets by 128 bits. Joins on a hub, whose pairs may be a large part of all,
broadcast the few hubs that hold more than 1/HOT of the pairs (at most HOT, by count) and shuffle the rest.

Cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a
shingle has are one shingle; equal texts are linked; ties of hash values and sizes are broken by the classes'
numbers, which no result shows; rows that repeat a doc_id are nodes of their own by their texts, and rows that
repeat it with the same set get the same result; rows without doc_id link others like any row but name no
component; very long texts are compared in groups of bounded size; further columns stay outside; an empty
table gives no rows.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .order_minhash import BASE, mix

WORDS = 5
SIMILAR = 75  # per cent
KEPT = 64
#: Of the sketches of classes in lists that hold several components.
KEPT_MORE = 512
#: Odds against which a pair just similar enough may fall through the sketches.
MISS = 1e-9
#: Bytes of the texts of a hub's partners that one group of the exact comparison holds.
GROUP_BYTES = 1 << 20
#: Up to so many entries a list's pairs are looked at directly.
FEW = 16
#: A key that more than 1/HOT of the rows hold is joined by broadcast; there can't be more than HOT of them.
HOT = 500
#: Powers up to this number are kept between calls.
KEPT_POWERS = 1 << 22


def least_shared(kept: int, similar: float, miss: float = MISS) -> int:
    """The most t such that of kept draws, each a hit with odds `similar`, fewer than t hit with odds below miss."""
    tail, t = 0.0, 0
    while True:
        tail += comb(kept, t) * similar**t * (1 - similar) ** (kept - t)
        if tail > miss:
            return max(1, t)
        t += 1


class Powers:
    """Powers of BASE and of its inverse mod 2**64, as far as a text needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            found = []
            for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                found.append(np.multiply.accumulate(a))
            if size > KEPT_POWERS:
                return found[0][:n], found[1][:n]
            cls.up, cls.down = found
        return cls.up[:n], cls.down[:n]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, in order, and where each text's words end in them. A-Z count as a-z."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = Powers.get(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, borders)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    if not texts:
        return []
    hashes, ends = word_hashes([(t or "").encode() for t in texts])
    h = np.zeros(len(hashes), np.uint64)
    for j in range(min(words, len(h))):
        h[: len(h) - j] = h[: len(h) - j] * BASE + hashes[j:]
    h = mix(h)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            v = b - a
            for x in hashes[a:b].tolist():
                v = (v * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([v ^ 0x5BD1E995], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def sketches(docs: DataFrame, kept: int = KEPT, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, size int (bytes of the text), n int, d1 and d2 long (what the set is known by), sketch array<long> (the kept least, by unsigned value)."""

    def run(batches):
        common.make_room()
        for batch in common.slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            n = np.array([len(s) for s in sets], np.int32)
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            d2 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.minimum(n, kept))]).astype(np.int32)
            values = np.concatenate([s[:kept] for s in sets]) if len(sets) else np.zeros(0, np.uint64)
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), size, pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))],
                ["doc_id", "text_hash", "size", "n", "d1", "d2", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, size int, n int, d1 long, d2 long, sketch array<long>")


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of left, a written table, with right, which has each key once. Keys of many rows go by broadcast."""
    n = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") * HOT > n).select(key)
    rare = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return rare.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key))


def union_estimate(pairs: DataFrame, nodes: DataFrame, kept: int) -> DataFrame:
    """pairs (a, b), a written table, with the sizes na, nb, and of the kept least values of both sketches' union: seen int
    (how many there are), shared int (how many both hold), whole boolean (they are the whole union: the counts are exact)."""
    side = lambda x: nodes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = join_hot(pairs, side("a"), "a").join(side("b"), "b")
    # Signed values sort in another order than unsigned ones; flipping the top bit makes the orders one.
    flip = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    both = both.withColumns({"_all": F.array_sort(flip(F.array_union("sa", "sb"))), "_common": flip(F.array_intersect("sa", "sb"))})
    whole = (F.col("na") <= kept) & (F.col("nb") <= kept)
    union = F.when(whole, F.col("_all")).otherwise(F.slice("_all", 1, kept))
    return both.select("a", "b", "na", "nb", F.size(union).alias("seen"), F.size(F.array_intersect(union, "_common")).alias("shared"), whole.alias("whole"))


def inverted(nodes: DataFrame, kept: int, need: int, similar: int) -> DataFrame:
    """c, n, weight (how often its values are shared), common (how many of its values others hold), v and place: of
    each class's retained values the rarest ones, of which a partner must share one, in order from the rarest."""
    values = nodes.select("c", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("c", "n").agg(F.sort_array(F.collect_set(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("weight"))
    retained = F.least("n", F.lit(kept))
    must = F.least(F.ceil(F.col("n") * similar / 100), F.lit(need))
    # Values of one class alone are the rarest and take the first places of those that count.
    places = retained - must + 1 - (retained - F.size("vs"))
    lists = held.where(places > 0).select("c", "n", "weight", F.size("vs").alias("common"), F.posexplode(F.slice("vs", 1, places)).alias("place", "x"))
    return lists.select("c", "n", "weight", "common", "place", "x.v")


def with_texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with the text of one row of each; key and text_hash say which."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    return nodes.join(texts, ["key", "text_hash"]).dropDuplicates(["c"])


def beside_hubs(pairs: DataFrame, texts: DataFrame, words: int, write: common.Tables, compare, schema: str) -> DataFrame:
    """What compare(hub, its set, [(partner, its set), ...]) gives as rows of schema, for pairs (a: hub, b: partner), a written table.

    texts: c, size, text. Partners of one a are dealt to groups of bounded bytes, each with a copy of a's text.
    """
    sizes = pairs.join(texts.select(F.col("c").alias("b"), F.col("size").cast("long").alias("size")), "b")
    sizes = write(sizes, "partners")
    total = sizes.groupBy("a").agg(F.sum("size").alias("total"))
    dealt = join_hot(sizes, total, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("total") / GROUP_BYTES)).alias("part"))
    wanted = dealt.select("a", "part", F.col("b").alias("c")).unionByName(dealt.select("a", "part", F.col("a").alias("c")).distinct())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, held = {}, 0
        start, sizes = 0, pdf["size"].tolist()
        for i, n in enumerate([*sizes, None]):  # a slice of the texts at a time: only sets are kept
            if n is None or (held + n > GROUP_BYTES and i > start):
                found |= zip(pdf["c"][start:i].tolist(), shingle_sets(pdf["text"][start:i].tolist(), words), strict=True)
                start, held = i, 0
            held += n or 0
        hub = found.pop(key[0])
        return pd.DataFrame(compare(key[0], hub, list(found.items())), columns=names)

    return wanted.join(texts.select("c", "size", "text"), "c").select("a", "part", "c", "size", "text").groupBy("a", "part").applyInPandas(run, schema)


def exact_jaccard(pairs: DataFrame, texts: DataFrame, words: int, write: common.Tables) -> DataFrame:
    """pairs (a, b) with inter int, both int (sizes of intersection and union of the full sets)."""

    def compare(a, hub, partners):
        out = []
        for b, s in partners:
            inter = len(np.intersect1d(hub, s, assume_unique=True))
            out.append((a, b, inter, len(hub) + len(s) - inter))
        return out

    return beside_hubs(pairs, texts, words, write, compare, "a long, b long, inter int, both int")


def differing_alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similar: int, words: int, write: common.Tables) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a: hub, b: class of the hub's lists): edges (a, b) of those linked with their hub, and pairs (a, b) of
    classes of one hub, of different roots, that can be linked though not both are linked with the hub. nodes: c, root.

    A class of n shingles differs from its hub of m by d: added shingles and missing ones. Two classes are alike
    if what they differ by, d + d' - 2 * shared, is at most f * (n + n'), f = (1 - s) / (1 + s). So they must share
    (d + d' - f * (n + n')) / 2 of their differences; that is more than (d + f * (m - n)) / 2 if the other one is not linked
    with the hub (d' > f * (n' + m)), and d - f * (n + n') in any case, since they can't share more than d'.
    """
    f, s = (100 - similar) / (100 + similar), similar / 100

    def compare(a, hub, partners):
        out = []
        for b, own in partners:
            added, missing = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
            n, m, d = len(own), len(hub), len(added) + len(missing)
            linked = d * (100 + similar) <= (n + m) * (100 - similar)
            half = d - max(1, ceil((d + f * (m - n)) / 2 - 1e-9)) + 1  # first places that count if the other one is far from the hub
            places = half if linked else max(half, d - max(1, ceil(d - f * n * (1 + 1 / s) - 1e-9)) + 1)
            out.append((a, b, n, d, linked, half, places, len(added), added.view(np.int64) if places > 0 else [], missing[: max(0, places - len(added))].view(np.int64)))
        return out

    schema = "h long, c long, n int, d int, linked boolean, half int, places int, n_added int, added array<long>, missing array<long>"
    found = write(beside_hubs(pairs, texts, words, write, compare, schema), "differences")
    shape = ["h", "c", "n", "d", "linked", "half"]
    # Added shingles in order from the rarest; those of one class alone take the first places. Then missing ones, by value.
    added = found.select("h", "c", F.explode("added").alias("v"))
    df = added.groupBy("h", "v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = added.join(df, ["h", "v"]).groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    alone = F.col("n_added") - F.size("vs")
    rare = found.join(held, ["h", "c"]).withColumn("alone", alone).where("places > alone").select(*shape, "alone", F.posexplode(F.slice("vs", 1, F.col("places") - F.col("alone"))).alias("at", "x"))
    rare = rare.select(*shape, (F.col("at") + F.col("alone")).alias("place"), "x.v")
    rest = found.select(*shape, "n_added", F.posexplode("missing").alias("at", "v")).select(*shape, (F.col("at") + F.col("n_added")).alias("place"), "v")
    entries = write(rare.unionByName(rest).join(nodes.select("c", "root"), "c"), "rare-differences")
    x, y = (entries.select("h", "v", *(F.col(k).alias(f"{k}{side}") for k in ("c", "n", "d", "linked", "half", "place", "root"))) for side in "xy")
    far = F.when(F.col("linkedx") | F.col("linkedy"), ~(F.col("linkedx") & F.col("linkedy"))).otherwise((F.col("placex") < F.col("halfx")) & (F.col("placey") < F.col("halfy")))
    must = (F.col("dx") + F.col("dy") - (F.col("nx") + F.col("ny")) * f) / 2 - 1e-9
    room = F.least(F.col("dx") - F.col("placex"), F.col("dy") - F.col("placey")) >= must
    alike = (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * similar) & (F.col("cx") < F.col("cy")) & (F.col("rootx") != F.col("rooty"))
    pairs = x.join(y, ["h", "v"]).where(alike & far & room).select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct()
    return found.where("linked").select(F.col("h").alias("a"), F.col("c").alias("b")), pairs


def larger_sketches(nodes: DataFrame, kept: int, words: int) -> DataFrame:
    """nodes (with text) with sketch."""
    names = nodes.columns

    def run(batches):
        common.make_room()
        for batch in common.slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[:kept].view(np.int64) for s in sets], pa.list_(pa.int64()))], [*names, "sketch"])

    return nodes.mapInArrow(run, nodes.withColumn("sketch", F.array(F.lit(0).cast("long"))).schema)


def components(edges: DataFrame, write: common.Tables | None = None) -> DataFrame:
    """Of edges (a, b): node and root, its component's least node. Alternating large and small stars until nothing changes."""
    sym = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = common.materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n, before = now.count(), None

    def least_of(e: DataFrame, many: int) -> DataFrame:
        """e (a, b) with m, the least b of each a; nodes of very many edges by broadcast."""
        least = e.groupBy("a").agg(F.min("b").alias("m"), (F.count(F.lit(1)) * HOT > many).alias("hot"))
        hot = F.broadcast(least.where("hot").select("a", "m"))
        rare = e.join(hot.select("a"), "a", "left_anti").join(least.where("not hot").select("a", "m"), "a")
        return rare.unionByName(e.join(hot, "a"))

    while True:
        large = least_of(sym(now), 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = common.materialise(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = least_of(down, n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = common.materialise(small, "edges")
        mark = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        common.release(now)
        common.release(large)
        now, n = after, mark[0]
        if mark == before or mark[0] == 0:
            break
        before = mark
    if write:
        write.written.append(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, similar: int = SIMILAR, kept: int = KEPT, words: int = WORDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, text_hash long, n_shingles long, component_id long, kept boolean."""
    share = similar / 100
    need = least_shared(kept, share)
    write = common.Tables()
    marks = write(sketches(docs, kept, words), "sketches")
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("key"), "text_hash")
    nodes = marks.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min(key).alias("k"), F.max("size").alias("size"), F.any_value("sketch").alias("sketch"))
    nodes = write(nodes.select("d1", "d2", "n", "rep", "k.*", "size", "sketch", F.monotonically_increasing_id().alias("c")), "classes")

    lists = write(inverted(nodes, kept, need, similar), "lists")

    # Each class against the hub of its lists.
    hubs = lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("c")).alias("minus"))).alias("h"), F.count(F.lit(1)).alias("many")).where("many > 1").select("v", (-F.col("h.minus")).alias("a"))
    starred = write(lists.join(hubs, "v").where("a <> c").select("a", F.col("c").alias("b")).distinct(), "starred")

    def may_link(kept: int, need: int):
        """What the sketches say: sizes, and enough shared values (if they are whole: as many as it takes)."""
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar
        sampled = F.col("shared") >= F.least(F.lit(need), F.ceil(F.col("seen") * similar / 100))
        return sizes & F.when(F.col("whole"), F.col("shared") * 100 >= F.col("seen") * similar).otherwise(sampled)

    fits = write(union_estimate(starred, nodes, kept).where(may_link(kept, need)), "hub-pairs")
    known = fits.where("whole").select("a", "b")
    linked = F.col("inter") * 100 >= F.col("both") * similar
    unsure = write(fits.where("not whole").select("a", "b"), "unsure")
    about = nodes.select("c", "key", "text_hash", "size")
    compared = unsure.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = write(with_texts(about.join(compared, "c"), docs), "texts")
    edges = write(known.unionByName(exact_jaccard(unsure, texts, words, write).where(linked).select("a", "b")), "hub-edges")
    roots = write(components(edges, write), "roots")

    # Lists of several components: larger sketches of their classes, fetched with their texts.
    entries = lists.select("v", "c").join(roots, F.col("c") == F.col("node"), "left").select("v", "c", F.coalesce("root", "c").alias("root"))
    open_lists = entries.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("v")
    opened = entries.join(open_lists, "v", "left_semi").select("c", "root").distinct()
    opened = with_texts(nodes.select("c", "n", "key", "text_hash", "size").join(opened, "c"), docs)
    opened = write(larger_sketches(opened, KEPT_MORE, words), "open-classes")
    more_need = least_shared(KEPT_MORE, share)
    again = write(inverted(opened, KEPT_MORE, more_need, similar).join(opened.select("c", "root"), "c").select("v", "c", "n", "weight", "common", "place", "root"), "open-lists")
    about_lists = again.groupBy("v").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("weight", (-F.col("c")).alias("minus"))).alias("h"), (F.min("root") != F.max("root")).alias("open")).where("open")
    about_lists = write(about_lists.select("v", "many", (-F.col("h.minus")).alias("a")), "about-lists")

    # Short ones: pairs of entries.
    few = again.join(about_lists.where(F.col("many") <= FEW).select("v"), "v", "left_semi")
    x, y = (few.select("v", *(F.col(k).alias(f"{k}{s}") for k in ("c", "n", "common", "place", "root"))) for s in "xy")
    allowed = (F.col("cx") < F.col("cy")) & (F.col("rootx") != F.col("rooty")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * similar)
    # In the list of the rarest value that a pair shares, all it shares stands at that place or later in both; what
    # one class alone holds is in no intersection but in the union. Sketches that are whole must share as much as the
    # sizes demand, others what the odds allow.
    later = F.least(F.col("commonx") - F.col("placex"), F.col("commony") - F.col("placey"))
    whole = F.greatest("nx", "ny") <= KEPT_MORE
    room = F.when(whole, later * 100 >= (F.col("nx") + F.col("ny") - later) * similar).otherwise(later >= more_need)
    direct = x.join(y, "v").where(allowed & room).select(F.col("cx").alias("a"), F.col("cy").alias("b"))

    # Longer ones: what their classes differ by from the hub.
    long_lists = about_lists.where(F.col("many") > FEW).select("v", "a")
    beside = write(again.join(long_lists, "v").where("a <> c").select("a", F.col("c").alias("b")).distinct(), "beside-hubs")
    more, by_difference = differing_alike(beside, opened, opened, similar, words, write)

    across = write(direct.unionByName(by_difference).distinct(), "across")
    across = write(union_estimate(across, opened, KEPT_MORE).where(may_link(KEPT_MORE, more_need)), "open-pairs")
    unsure = write(across.where("not whole").select("a", "b"), "unsure")
    more = more.unionByName(across.where("whole").select("a", "b")).unionByName(exact_jaccard(unsure, opened, words, write).where(linked).select("a", "b"))
    joined = components(edges.unionByName(more), write)

    least = nodes.join(joined, F.col("c") == F.col("node"), "left").select("d1", "d2", "n", "rep", F.coalesce("root", "c").alias("root"))
    component = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = least.join(component, "root").select("d1", "d2", "n", "component_id")
    out = marks.select("doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    component_id = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("doc_id")).alias("kept"))
    return write.last(out)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
