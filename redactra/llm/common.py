"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    # SparkContext has its own checkpoint folder if a caller has set one.
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="redactra-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path for ``label`` in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def made():
    """Collects the paths of the tables that ``written`` makes inside, in this thread; a list, in order."""
    outer, paths = getattr(_open, "paths", None), []
    _open.paths = paths
    try:
        yield paths
    finally:
        _open.paths = outer
        if outer is not None:
            outer.extend(paths)


#: Rows and bytes of an Arrow batch while a table is written: rows may hold whole texts or arrays.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession):
    """Queries planned inside hand rows to Python in batches within ``BATCH``, or within the session's bounds where these are tighter."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    tight = lambda k: before[k] and before[k].isdigit() and 0 < int(before[k]) < int(BATCH[k])
    try:
        for k, v in BATCH.items():
            if not tight(k):
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if (paths := getattr(_open, "paths", None)) is not None:
        paths.append(path)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no result reads any more; finished shuffles' files go too."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage: finished plans and broadcast tables leave its heap, which shrinks.

    Spark removes shuffle files and broadcasts when the driver has collected the objects that stand for them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all ``columns``, whatever their case."""
    there, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in there:
            n = "_" + n
        there.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id gives 0's place, i.e. it belongs to no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most ``rows`` rows, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8 bytes (bytes methods know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written ``table`` with a broadcast hint if it has at most ``most`` rows, of a bounded width; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def hash_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows with the smallest hash of ``key``, or all if there are fewer.

    Rows are counted first, so that each task hands on little more than its share of the n.
    """
    h = F.xxhash64(*key)
    total = df.count()
    share = min(1.0, (n + 6 * n**0.5 + 50) / max(total, 1))
    few = df if share >= 1 else df.filter(F.shiftrightunsigned(h, 11) < int(share * (1 << 53)))
    return few.orderBy(F.shiftrightunsigned(h, 11), *key).limit(n)
