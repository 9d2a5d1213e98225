"""Tables in the shared folder that the session names: they cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from acequia.llm.words import forget_powers

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own;
    a cluster session fails, since its executors share no local disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="acequia-llm-"))
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


#: Has Spark remove an action's shuffle files as soon as the action ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions in this block leave no shuffle files, which otherwise stay until the driver happens to
    collect its garbage. For results that are stored or collected, since nothing reads the files again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote and no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Rows with ``name``, their place from 0 in the given order. Every task numbers a range of the
    order; only one row a task is summed to find where each range starts."""
    split = df.repartitionByRange(*order).sortWithinPartitions(*order)
    split = saved(split.withColumn("acequia_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("acequia_at", 33)
    sizes = split.groupBy(part.alias("acequia_part")).agg(F.count(F.lit(1)).alias("acequia_rows"))
    earlier = Window.orderBy("acequia_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("acequia_part", F.coalesce(F.sum("acequia_rows").over(earlier), F.lit(0)).alias("acequia_start"))
    return split.join(starts, part == F.col("acequia_part")).select(
        *df.columns, (F.col("acequia_start") + F.col("acequia_at").bitwiseAND((1 << 33) - 1)).alias(name))


#: Clears what a process keeps for later tasks, by the module whose tasks use it.
_kept: dict[str, Callable[[], None]] = {}


def kept(make: Callable) -> Callable:
    """Has a process keep what a function makes for later tasks of its module. Tasks of other modules let it go."""
    held = lru_cache(maxsize=1)(make)
    _kept[make.__module__] = held.cache_clear
    return held


def _let_go(user: str) -> None:
    for module, clear in _kept.items():
        if module != user:
            clear()


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut small: a part's arrays are many times as large as its rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system after each batch that it yields, and at its
    end, when its own arrays are gone. Workers are used again by later tasks, or stay idle, and what they keep
    counts against the executor: so a task first lets go what other modules' tasks have left."""
    user = run.__module__

    def wrapped(batches):
        _let_go(user)
        try:
            for batch in run(batches):
                yield batch
                batch = None
                _give_back()
        finally:
            forget_powers()
            _give_back()
    return wrapped


def lean_groups(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of a group's table, or of the tables of a cogroup: memory goes back after each group."""
    def one(table):
        try:
            return run(table)
        finally:
            _give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            _give_back()
    return one if len(signature(run).parameters) == 1 else two


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
