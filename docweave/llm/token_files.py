"""Token-ID output: Arrow IPC files of equal-length sequences with masks, for zero-copy random access.

A file holds record batches of one shape: `ids` is fixed_size_list<uint16 or uint32>[sequence], `mask`
fixed_size_list<bool>[sequence] (false: padding, at a file's end alone). The ids of its documents follow
one another in ascending doc_id order; a second file lists (doc_id, first, n_tokens) for each document,
first counted in the file's ids. Sequence s is row s % rows of batch s // rows: a memory-mapped reader
gets it without decoding or copying.

Cases: a null text counts as empty, its document is the end id alone; an empty table gives no files and
no rows; rows of equal doc_id stand in order of their texts, null doc_ids first; further columns are
not written. Files are written under a name of their own attempt and then renamed; a task that is run again
writes the same files under the same names, since the texts of a range come in one order and files end
where their ids do.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

SEQUENCE = 2048
ROWS = 128
#: A file is closed at the first document after so many ids.
FILE_IDS = 32 << 20
#: Of each of a worker's two tables of remembered words.
MEMO_BYTES = 112 << 20
#: White space for str.split() but not for the tokenizer.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


class WordCodec:
    """Encodes as the tokenizers library does with a word-end vocabulary: NFC, lower case, white space dropped.

    White space never enters a token, so a text's pieces between white space are encoded on their own
    and remembered (a bounded number); BPE runs on new words only.
    """

    def __init__(self, spec: dict):
        self.bpe = bpe.SpeculativeBpe(spec)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.dtype = np.uint16 if max(self.bpe.size, *self.special.values()) <= 0x10000 else np.uint32
        self.memo, self.pieces = bpe.Memo(MEMO_BYTES), bpe.Memo(MEMO_BYTES)
        self.code = "H" if self.dtype is np.uint16 else "I"

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # str.lower() looks at what stands around a capital sigma, the library does not.
        return "σ".join(p.lower() for p in text.split("Σ")) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [w for part in regex.split(r"\s+", self.normal(text)) for w in [part] if w]
        return self.normal(text).split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []
        for t in texts:
            if self.cut is not None and any(s in t for s in self.special):
                row, at = [], 0
                for m in self.cut.finditer(t):
                    row += [self.split(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                parts.append([*row, self.split(t[at:])])
            else:
                parts.append([self.split(t)])
        pieces = self.pieces
        # Of letters alone, a piece is one word.
        split = {w: [w] if w.isalpha() else self.words.findall(w) for w in pieces.unknown([p for row in parts for p in row if isinstance(p, list)])}
        new = list(self.memo.unknown(split.values()))
        for w, ids in zip(new, self.bpe.encode_words([w.encode() + self.bpe.end for w in new]), strict=True):
            self.memo.ids[w] = array(self.code, ids).tobytes()
        known = self.memo.ids.__getitem__
        for w, ws in split.items():
            pieces.ids[w] = known(w) if len(ws) == 1 else b"".join(map(known, ws))
        known = pieces.ids.__getitem__
        return [b"".join([b"".join(map(known, p)) if isinstance(p, list) else self.dtype(p).tobytes() for p in row]) for row in parts]


_codecs: dict[int, WordCodec] = {}


def codec(content: bytes) -> WordCodec:
    common.make_room("words")
    common.keeps("words", _codecs.clear)
    key = hash(content)
    if key not in _codecs:
        _codecs[key] = WordCodec(json.loads(content))
        bpe.rest_collector()
    return _codecs[key]


def open_fs(uri: str):
    """The file system and path of a URI; any that Arrow knows (file, hdfs, s3, gs)."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


class SequenceWriter:
    """Writes ids as sequences; holds one batch of them at most, besides the document being added."""

    def __init__(self, uri: str, name: str, attempt: str, dtype, sequence: int):
        self.fs, folder = open_fs(uri)
        self.fs.create_dir(folder, recursive=True)
        self.paths = {k: (f"{folder}/_{name}.{k}.{attempt}", f"{folder}/{name}.{k}.arrow") for k in ("seqs", "docs")}
        kind = pa.from_numpy_dtype(dtype)
        self.sequence, self.dtype, self.kind = sequence, dtype, kind
        self.schemas = {
            "seqs": pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))]),
            "docs": pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())]),
        }
        self.sinks = {k: self.fs.open_output_stream(p[0]) for k, p in self.paths.items()}
        self.writers = {k: pa.ipc.new_file(self.sinks[k], self.schemas[k]) for k in self.paths}
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(i) for i in ids], np.int64)
        first = self.n_ids + np.cumsum(sizes) - sizes
        self.writers["docs"].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(first), pa.array(sizes)], schema=self.schemas["docs"]))
        self.held += ids
        self.n_ids += int(sizes.sum())
        self.n_held += int(sizes.sum())
        self.n_docs += len(ids)
        if self.n_held >= self.sequence * ROWS:
            self._flush(self.sequence * ROWS)

    def _flush(self, shape: int, pad: bool = False) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        whole = len(flat) - len(flat) % shape
        for at in range(0, whole, shape):
            self._batch(flat[at : at + shape], shape)
        flat = flat[whole:].copy()
        if pad and len(flat):
            size = -(-len(flat) // self.sequence) * self.sequence
            self._batch(np.concatenate([flat, np.zeros(size - len(flat), self.dtype)]), len(flat))
            flat = flat[:0]
        self.held, self.n_held = [flat], len(flat)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        self.writers["seqs"].write_batch(pa.record_batch(lists, schema=self.schemas["seqs"]))

    def close(self) -> None:
        self._flush(self.sequence * ROWS, pad=True)
        for k, (temporary, final) in self.paths.items():
            self.writers[k].close()
            self.sinks[k].close()
            self.fs.move(temporary, final)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, uri: str, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the token files of docs (doc_id, text) below uri and returns their list, which is small:
    part int, file int, n_docs long, n_ids long, uri string; in order of (part, file).

    One shuffle: texts are dealt to ranges of doc_id, each range is encoded and written as one stream.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(bpe.read_file(vocabulary))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        c, task = codec(content.value), TaskContext.get()
        writer, number, done = None, 0, []
        for batch in common.slices(batches, "text"):
            ids = c.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            if writer is None:
                writer = SequenceWriter(uri, f"part-{task.partitionId():06d}-{number:04d}", f"{task.taskAttemptId()}", c.dtype, sequence)
            writer.add(batch.column(0).to_pylist(), [np.frombuffer(i + c.dtype(end_id).tobytes(), c.dtype) for i in ids])
            if writer.n_ids >= FILE_IDS:
                writer.close()
                done.append((number, writer.n_docs, writer.n_ids))
                writer, number = None, number + 1
        if writer is not None:
            writer.close()
            done.append((number, writer.n_docs, writer.n_ids))
        for n, docs_in, ids_in in done:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": pa.array([n], pa.int32()), "n_docs": [docs_in], "n_ids": [ids_in], "uri": [f"{uri}/part-{task.partitionId():06d}-{n:04d}"]})

    return common.materialise(ordered.mapInArrow(run, "part int, file int, n_docs long, n_ids long, uri string"), "token-files")


class SequenceFile:
    """Random access to a token file; memory-mapped where the file system is local."""

    def __init__(self, uri: str, kind: str):
        fs, path = open_fs(f"{uri}.{kind}.arrow")
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

    def batches(self):
        return (self.reader.get_batch(i) for i in range(self.reader.num_record_batches))

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view) and mask of sequence s."""
        batch = self.reader.get_batch(s // ROWS)
        ids, mask = (batch.column(k)[s % ROWS].values for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files.

    The list of files goes through the driver, a row for each; the ids stay on the executors.
    """
    spark = files.sparkSession
    rows, start = [], 0
    for r in sorted(files.collect(), key=lambda r: (r.part, r.file)):
        rows.append((r.uri, start))
        start += r.n_ids
    parts = spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows)))

    def run(batches):
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream, held, done = SequenceFile(uri, "seqs").batches(), np.zeros(0, np.uint16), 0
                for docs in SequenceFile(uri, "docs").batches():
                    at, sizes = (docs.column(k).to_numpy() for k in (1, 2))
                    crcs = []
                    for n in sizes.tolist():
                        crc = 0
                        while n:
                            if done == len(held):
                                lists = next(stream).column(0)
                                held, done = lists.values.to_numpy(zero_copy_only=True), 0
                            part = held[done : done + n]
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            done, n = done + len(part), n - len(part)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + first), docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the tokens of documents with end id 2 and reads them back."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    uri = common.scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, bpe.tokenizer_path("word_bpe_49k.json"), 2, uri))
