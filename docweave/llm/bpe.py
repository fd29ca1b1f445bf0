"""BPE encoding and decoding by speculation: greedy longest match proposes, vectorised checks verify.

A token sequence is the BPE encoding of a word exactly if each token encodes to itself and each
adjacent pair of tokens is compatible, that is, no merge across their border would have come before
the merges that built them. So a word's greedy longest-match tokens are accepted when all its pairs
pass, and only the other words are merged exactly.

Cases: a null text counts as empty (no ids, empty decoded text); very long words are merged in
O(n log n); texts may hold the special tokens' strings, which become their ids; every row is encoded
on its own, so ties, repeated rows and further columns change nothing (columns bpe_ids and bpe_decoded
are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import gc
import heapq
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The pattern of byte-level tokenizers that splits a text before the merges (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for the end-of-word suffix in token bytes; UTF-8 never holds this byte.
END = b"\xff"
#: Stands between words; no token holds it.
BETWEEN = "\u0100"
#: A worker remembers the ids of words in two tables of about so many bytes each.
MEMO_BYTES = 40 << 20
#: What an entry takes besides its text.
ENTRY_BYTES = 180
#: Up to so many symbols words are merged together, as rows of tables; longer ones over a heap.
SHORT = 48


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as char -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SpeculativeBpe:
    """Encodes words (bytes) with the vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        to_byte = byte_chars()
        suffix = model.get("end_of_word_suffix") or ""
        self.end = END if suffix else b""

        def raw(token: str) -> bytes:
            tail = suffix and token.endswith(suffix)
            body = token[: -len(suffix)] if tail else token
            return bytes(to_byte[c] for c in body) + (END if tail else b"")

        self.ids: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items()}
        self.size = size = max(self.ids.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        self.rank = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, t = self.ids[a], self.ids[b], self.ids[a + b]
            if (a, b) not in self.merges:
                self.merges[a, b] = (r, t)
                if self.rank[t] < 0:
                    self.rank[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        made = self.rank >= 0
        # The check walks the parts of two tokens from the last merge backwards; that needs merges in the order of their making.
        self.ordered = bool((self.rank[made] > np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).all())
        self.key_due = np.array([r * size + t for r, t in self.merges.values()], np.int64)[order]
        self.symbol = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            if b == self.end:
                continue  # the token of a byte that UTF-8 never holds
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        #: By id: 1 the token encodes to itself, 0 it does not, -1 not yet known.
        self.whole = np.full(size, -1, np.int8)

    def first_symbols(self, word: bytes) -> list[int]:
        if not self.end or not word.endswith(self.end):
            return list(map(self.symbol.__getitem__, word))
        return [*map(self.symbol.__getitem__, word[:-2]), self.ids[word[-2:]]]

    def exact(self, word: bytes) -> list[int]:
        """Merges the lowest rank first, the leftmost of equal ranks first."""
        ids = self.first_symbols(word)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = t, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((t, ids[k])):
                    heapq.heappush(heap, (m[0], i, t, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], t))):
                heapq.heappush(heap, (m[0], h, ids[h], t, m[1]))
        return [x for x in ids if x >= 0]

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """exact() of many words: those of as many symbols are rows of one table, and each step merges one pair in every row."""
        out: list = [None] * len(words)
        symbols = [self.first_symbols(w) for w in words]
        of_length: dict[int, list[int]] = {}
        for k, ids in enumerate(symbols):
            if len(ids) <= SHORT:
                of_length.setdefault(len(ids), []).append(k)
            else:
                out[k] = self.exact(words[k])
        none = np.int64(1) << np.int64(62)

        def due(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """rank * size + the merged token, for pairs that merge."""
            key = a * self.size + b
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[pos] == key, self.key_due[pos], none)

        for n, at in of_length.items():
            owner, ids = np.array(at), np.array([symbols[k] for k in at], np.int64).reshape(len(at), n)
            ranks = due(ids[:, :-1], ids[:, 1:])
            while True:
                first = ranks.argmin(axis=1) if n > 1 else np.zeros(len(owner), np.int64)
                rows = np.arange(len(owner))
                best = ranks[rows, first] if n > 1 else np.full(len(owner), none)
                done = best == none
                for k, row in zip(owner[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = row
                if done.all():
                    break
                go = ~done
                owner, ids, ranks, first, best = owner[go], ids[go], ranks[go], first[go], best[go]
                rows = np.arange(len(owner))
                ids[rows, first] = best % self.size
                left = np.ones(ids.shape, bool)
                left[rows, first + 1] = False
                ids, ranks = ids[left].reshape(len(owner), n - 1), ranks[left[:, 1:]].reshape(len(owner), n - 2)
                n -= 1
                before = np.flatnonzero(first > 0)
                ranks[before, first[before] - 1] = due(ids[before, first[before] - 1], ids[before, first[before]])
                after = np.flatnonzero(first < n - 1)
                ranks[after, first[after]] = due(ids[after, first[after]], ids[after, first[after] + 1])
        return out

    def propose(self, words: list[bytes]) -> list[list[int]]:
        """Longest match from the left, in one run over all words. [] where that leaves something over."""
        out: list[list[int]] = [[] for _ in words]
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        joined = BETWEEN.join([w.decode("latin-1") for w in words]) + BETWEEN
        k, end, at, row = -1, 0, 0, None
        for last, (i, n) in self.automaton.iter_long(joined):
            while last >= end:
                if row and at != end - 1:
                    self._mend(row, words[k], at + len(words[k]) - end + 1)
                k += 1
                at, end, row = end, ends[k], out[k]
            if last + 1 - n == at:
                row.append(i)
                at = last + 1
        if row and at != end - 1:
            self._mend(row, words[k], at + len(words[k]) - end + 1)
        return out

    def _mend(self, row: list[int], word: bytes, covered: int) -> None:
        """Where only the end mark is left over, the last token is proposed anew together with it."""
        if covered + 1 == len(word) and self.end:
            tail = self.bytes[row.pop()] + self.end
            while tail:
                n = next((n for n in range(len(tail), 0, -1) if n != len(tail) - 1 and tail[:n] in self.ids and tail[:n] != self.end), 0)
                if not n:
                    break
                row.append(self.ids[tail[:n]])
                tail = tail[n:]
            if not tail:
                return
        row.clear()

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border?"""
        ok = np.ones(len(a), bool)
        x, y, at = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        until = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = x * self.size + y
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[pos] == key) & (self.key_rank[pos] < until)
            ok[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & (np.maximum(rx, ry) >= 0)
            x, y, at, until, rx, ry = x[on], y[on], at[on], until[on], rx[on], ry[on]
            undo_x = rx > ry  # of equal ranks the right one was made last
            until = np.where(undo_x, rx, ry + 1)  # its own merge came first on the left, the crossing one first on the right
            x = np.where(undo_x, self.right[x], x)
            y = np.where(undo_x, y, self.left[y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodes non-empty words (with the end mark, if the vocabulary has one)."""
        if not self.ordered:
            return self.exact_many(words)
        found = self.propose(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        for i in np.unique(flat[self.whole[flat] < 0]):
            self.whole[i] = self.exact(self.bytes[i]) == [i]
        owner = np.repeat(np.arange(len(found)), sizes)
        bad = sizes == 0
        bad[owner[self.whole[flat] == 0]] = True
        joint = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[joint] * self.size + flat[joint + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[joint[~fine[back]]]] = True
        failed = np.flatnonzero(bad).tolist()
        for k, ids in zip(failed, self.exact_many([words[k] for k in failed]), strict=True):
            found[k] = ids
        return found


class Memo:
    """Ids of texts as bytes; before they would take more than `most` bytes, only what is wanted now stays."""

    def __init__(self, most: int):
        self.ids: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def unknown(self, rows: list) -> set[str]:
        """What of rows of texts it doesn't know, with room for it."""
        ids = self.ids
        new = {w for row in rows for w in row if w not in ids}
        n = sum(map(len, new)) + len(new) * ENTRY_BYTES
        if self.held and self.held + n > self.most:
            self.ids = {w: ids[w] for row in rows for w in row if w in ids}
            self.held = sum(map(len, self.ids)) + len(self.ids) * ENTRY_BYTES
        self.held += n
        return new


class TextCodec:
    """Whole texts to ids and back; remembers the ids of recent words (a bounded number)."""

    def __init__(self, spec: dict):
        self.bpe = SpeculativeBpe(spec)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(BYTE_LEVEL)
        self.spaced, self.memo = Memo(MEMO_BYTES), Memo(MEMO_BYTES)
        self.table = list(self.bpe.bytes)
        for text, i in self.special.items():
            self.table.extend([b""] * (i + 1 - len(self.table)))
            self.table[i] = text.encode()

    def learn(self, words: set[str]) -> None:
        new = list(self.memo.unknown([words]))
        for w, ids in zip(new, self.bpe.encode_words([w.encode() for w in new]), strict=True):
            self.memo.ids[w] = array("i", ids).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32 bytes.

        A text without a special token whose white space is single spaces between other characters
        falls apart at these spaces; its pieces are looked up. Other texts go through the pattern.
        """
        pieces = [t.split(" ") for t in texts]
        spaced = self.spaced
        whole = [(self.cut is not None and any(s in t for s in self.special)) or p[0][-1:].isspace() or (len(p) > 1 and not p[0]) for t, p in zip(texts, pieces, strict=True)]
        firsts = [p.pop(0) for p in pieces]
        # A piece at the very end may end in white space, but the simple rule sends that text the slow way as well.
        known = spaced.ids
        odd = {w for p in pieces for w in p if w not in known and (not w or w[0].isspace() or w[-1].isspace())}
        if odd:
            whole = [w or not odd.isdisjoint(p) for p, w in zip(pieces, whole, strict=True)]
        split = {w: self.words.findall(" " + w) for w in spaced.unknown([p for p, w in zip(pieces, whole, strict=True) if not w])}
        rest = [self._slow(t) if w else [self.words.findall(first)] for t, w, first in zip(texts, whole, firsts, strict=True)]
        self.learn({w for ws in split.values() for w in ws} | {w for parts in rest for part in parts if isinstance(part, list) for w in part})
        known = self.memo.ids.__getitem__
        for w, ws in split.items():
            spaced.ids[w] = b"".join(map(known, ws))
        heads = [b"".join(np.int32(part).tobytes() if isinstance(part, int) else b"".join(map(known, part)) for part in parts) for parts in rest]
        known = spaced.ids.__getitem__
        return [head if w else head + b"".join(map(known, p)) for head, w, p in zip(heads, whole, pieces, strict=True)]

    def _slow(self, text: str) -> list:
        if self.cut is None:
            return [self.words.findall(text)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.words.findall(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self.words.findall(text[at:])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[int, TextCodec] = {}


def codec(content: bytes) -> TextCodec:
    """One codec for each vocabulary and worker process."""
    common.make_room("bpe")
    common.keeps("bpe", _codecs.clear)
    key = hash(content)
    if key not in _codecs:
        _codecs[key] = TextCodec(json.loads(content))
        rest_collector()
    return _codecs[key]


def rest_collector() -> None:
    """The tables of a codec hold no cycles; looking for some in them again and again takes a tenth of the time."""
    gc.freeze()
    gc.set_threshold(200_000, 20, 20)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with columns bpe_ids array<int> and bpe_decoded string; columns of these names are replaced.

    vocabulary: path of a tokenizers JSON file on the driver; its content (a few MB, whatever the
    input) is broadcast. Null counts as empty. No shuffle: each batch of rows is encoded where it is.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_file(vocabulary))
    docs = docs.drop("bpe_ids", "bpe_decoded")
    names = docs.columns
    at = names.index(text)
    schema = docs.withColumns({"bpe_ids": F.array(F.lit(0)), "bpe_decoded": F.lit("")}).schema

    def run(batches):
        c = codec(content.value)
        for batch in common.slices(batches, names[at], 2 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            raw = c.encode_batch(texts)
            ids = [np.frombuffer(r, np.int32) for r in raw]
            ends = np.zeros(len(raw) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            decoded = pa.array([c.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], [*names, "bpe_ids", "bpe_decoded"])

    return docs.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of documents through encode_decode(), as digests."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_decoded"), 256).alias("decoded_sha256"),
    )
