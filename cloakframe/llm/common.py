"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


#: Elements of a block of ``running``.
BLOCK = 64


def blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` elements, the last one shorter."""
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(v, i + 1, F.lit(BLOCK))))


def running(values: Column, combine) -> Column:
    """For each element of an array of non-negative ints, ``combine`` over all elements before it, from zero.

    Arrays are copied when they grow, so this goes in blocks: the cost is near the number of elements, not its square.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    inner = F.transform(blocks(values), lambda b: F.aggregate(b, start, step))
    return let(inner, lambda i: F.flatten(F.zip_with(i, F.aggregate(i["at"], start, step)["out"], lambda b, o: F.transform(b["out"], lambda x: combine(x, o).cast("int")))))


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        base = _own[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python functions of actions in this block get ``rows`` rows at once at most; each batch is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) < 1 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_occupant: str | None = None
_left_behind: list[Callable[[], None]] = []


def dropped_by_others(clear: Callable[[], None]) -> None:
    """``clear`` empties what an operator keeps in a worker process between its tasks; it runs when another operator's task begins there."""
    _left_behind.append(clear)


def give_back() -> None:
    """Memory of this process that is free goes back to the system, which neither Arrow nor the C library does by itself."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def occupies(operator: str) -> None:
    """Call it where a Python function begins. Workers are used again by the tasks of all operators: what another one has kept
    goes, and free memory with it."""
    global _occupant
    if operator != _occupant:
        for clear in _left_behind:
            clear()
        _occupant = operator
    give_back()


def written() -> int:
    """How many paths there are so far, for ``release``."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Remove what was written since then, but for the tables in ``keep`` as ``durable`` gave them. Nothing that is still to be read may depend on the rest."""
    kept = {getattr(df, "stored_at", None) for df in keep}
    for entry in [e for e in _written[since:] if e[1] not in kept]:
        _remove(*entry)
        _written.remove(entry)


#: Rows up to which a table of narrow rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000

#: A key is heavy if it has over one in so many of a table's rows; fewer keys than that can be.
HEAVY = 2000


def join_unique(left: DataFrame, right: DataFrame, key: str, n: int | None = None, heavy: int | None = None, small: int | None = None) -> DataFrame:
    """Inner join with a table that has one row for each key, where a key may have a large part of ``left``'s rows.

    Heavy keys, fewer than ``HEAVY`` by their definition, are joined by broadcast, so their rows stay where they are; all other
    keys are dealt out. ``left`` should be a stored table; ``n`` is its number of rows if known;
    a smaller ``heavy`` than ``HEAVY`` keeps the broadcast small where rows of ``right`` are wide. A narrow ``right`` that is
    counted to be small is broadcast as a whole, if it is stored: ``small`` is its number of rows.
    """
    if small is not None and small <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    n = left.count() if n is None else n
    heavy = left.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") * (heavy or HEAVY) > n).select(key)
    few = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))
    light = left.join(F.broadcast(heavy), key, "left_anti").join(right, key)
    hot = left.join(few, key)
    return light.unionByName(hot.select(*light.columns))


@atexit.register
def _remove_written() -> None:
    for entry in _written:
        try:
            _remove(*entry)
        except Exception:  # the session may have ended already
            pass


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc32_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
