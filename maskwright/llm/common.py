"""What the corpus operators share: table reading, shared storage and Arrow batch plumbing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse
from pathlib import Path
from tempfile import gettempdir

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows a Python operator handles at a time; a batch of very long texts stays small.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by whatever file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local session (one JVM) gets
    a folder of this machine; any other is refused, as its executors would not see that folder.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
    return f"file://{Path(gettempdir()) / 'maskwright-shared'}"


def unique(what: str) -> str:
    """A folder name that no other run uses."""
    return f"{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{unique(what)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a worker has made of shipped files.
MADE: dict[tuple[str, str], object] = {}


class Shipped:
    """A small file of the driver's machine, broadcast as bytes: executors need not have it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        data = Path(path).read_bytes()
        self.digest, self.suffix = hashlib.sha256(data).hexdigest(), Path(path).suffix
        self.data = spark.sparkContext.broadcast(data)

    def made(self, build: Callable[[bytes, str], object]):
        """``build`` of the bytes and the file's suffix, once for each file and worker process."""
        key = (build.__qualname__, self.digest)
        if key not in MADE:
            MADE[key] = build(self.data.value, self.suffix)
        return MADE[key]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into short runs of rows, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Scratch:
    """Tables of one computation in the shared folder, which go together when it is over.

    What is read after that must have been written elsewhere, or a lost executor could not be made up for.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/{unique(what)}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table."""
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes all tables, by Spark's own access to the folder's file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot from this share of the rows; so there are at most so many hot keys as its inverse.
HOT = 1 / 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left_semi) with ``right``, which has one row for a ``key``, however many rows of ``left`` share it.

    ``sizes`` (key, n) says how many do. Hot keys, of which there are at most 1 / ``HOT``, are
    broadcast with their rows of ``right``, so that no task gets all rows of such a key; the others are
    dealt by key. ``left`` is read twice and should be a table.
    """
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    least = max(1000.0, HOT * (total or 0))
    if not most or most < least:
        return left.join(right, key, how)
    hot = sizes.filter(F.col("n") >= least).select(key)
    many = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(many, key, how).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def extended(schema: StructType, **new: DataType) -> StructType:
    """A schema with further columns; the given one stays as it is."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in new.items())])


def give_back() -> None:
    """Returns to the system what a worker process holds but no longer uses.

    Workers live on from task to task and from stage to stage; tables that refer to each other go only when
    they are looked for, and allocators keep freed pages.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def in_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = SLICE_ROWS, over: Callable[[], None] = lambda: None) -> DataFrame:
    """``work`` on each short run of rows of ``df``: one pass, no shuffle. ``over`` is called at the end of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            for part in slices(batches, rows):
                yield work(part)
        finally:
            over()
            give_back()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def word_runs(text: str, run: int = 1 << 16) -> Iterator[list[str]]:
    """Words between white space: all at once, or some at a time if the text is very long."""
    if len(text) <= run * 16:
        yield text.split()
    else:
        some = []
        for m in re.finditer(r"\S+", text):
            some.append(m.group())
            if len(some) == run:
                yield some
                some = []
        yield some


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled training rows, those of the smallest id hashes.

    Rows with the same text teach once, with the smallest doc_id and its label, so the bound counts texts.
    A doc_id with several labels counts with the smallest; null labels and ids teach nothing. Only
    ids, digests and labels are sorted; what is broadcast to the texts has at most ``rows`` rows.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    text = F.col("text").cast("string")
    known = labels.select(doc_id, F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & training_row(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    own = docs.select(doc_id, text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))
    single = own.select("doc_id", "digest").distinct().join(known, "doc_id").groupBy("digest").agg(F.min(F.struct("doc_id", "label")).alias("first"))
    chosen = single.select("first.*", "digest").orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(rows)
    return own.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "label")


def training_row(doc_id: Column) -> Column:
    """Labels may be learned only where crc32 of the id's text is no multiple of 5 (null: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """The rows on which a classifier is judged; a null id counts as held out."""
    return ~training_row(doc_id)


class BoundedCache(dict):
    """A dict for a worker's lifetime that holds at most two generations of ``limit`` keys.

    When the young generation is full it becomes the old one and the former old one goes, so
    memory is bounded however many keys pass, and common keys are found again.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys not held. Those of the old generation move to the young one."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        absent = []
        for k in set(filterfalse(self.__contains__, keys)):
            if (v := self.old.get(k)) is None:
                absent.append(k)
            else:
                self[k] = v
        return absent
