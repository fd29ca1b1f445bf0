"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
FALLBACK_SHARED = "file:///tmp/checkpoints/docweave"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, our own, if driver and executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or FALLBACK_SHARED).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"
    fs, there = _hadoop(spark, path)
    atexit.register(_delete, fs, there)
    return path


def _delete(fs, there) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        fs.delete(there, True)


def _hadoop(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and any executor can be lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    fs, there = _hadoop(df.sparkSession, df._docweave_path)
    fs.delete(there, True)


class Tables:
    """Writes tables by materialise() and knows which, so that they can go when the last one is made."""

    def __init__(self):
        self.written: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(materialise(df, name))
        return self.written[-1]

    def last(self, df: DataFrame) -> DataFrame:
        """df as a table of its own, without the tables that it was made from."""
        out = materialise(df, "result")
        for t in self.written:
            release(t)
        return out


#: By operator, what empties the tables that it keeps in a worker process.
_kept: dict = {}


def keeps(name: str, clear) -> None:
    _kept[name] = clear


def make_room(name: str = "") -> None:
    """Called in a worker where an operator begins: what other operators keep there goes, workers serve one after another."""
    for other, clear in list(_kept.items()):
        if other != name:
            clear()
            del _kept[other]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, text: str, most_bytes: int = 4 << 20, most_rows: int = 4096):
    """Cuts Arrow batches so that a slice holds about most_bytes of text, or one row."""
    for batch in batches:
        col = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  binds pa.compute
