"""Shared pieces of the corpus operators: tables, the shared work folder, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the input tables, cut down to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset.

    In local mode, where driver and executors are one process, a temporary folder stands in for an unset one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pagewarden-work"
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pagewarden-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def new_folder(spark: SparkSession, kind: str) -> str:
    _MADE.append(path := f"{work_dir(spark)}/pagewarden-{kind}-{uuid.uuid4().hex}")
    return path


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder, once nothing lazy reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def tidy(spark: SparkSession) -> None:
    """Deletes every folder that operators made so far; for callers whose results are all written elsewhere."""
    deleted(spark, *list(_MADE))


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows in the Arrow batches between Spark and its Python workers, unless the session already says so."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results are stored; Spark does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def given_back() -> None:
    """Gives the memory that this process has freed back to the system, which allocators otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no malloc_trim() but in glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable) -> Callable:
    """A function for mapInArrow() or applyInArrow() that gives its memory back at its end.

    Workers wait for further tasks and meanwhile count as memory of their executor, beside tasks that need no Python.
    """

    def over_batches(batches):  # noqa: ANN001, ANN202
        yield from work(batches)
        given_back()

    def of(x):  # noqa: ANN001, ANN202
        if isinstance(x, Iterator):
            return over_batches(x)
        try:
            return work(x)
        finally:
            given_back()

    return of


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled as the other one is, never broadcast.

    Spark judges a stored table by its compressed files, which may be a hundredth of the rows that the driver would
    gather and hold for a broadcast.
    """
    return df.hint("merge")


def kept_by_size(df: DataFrame, ids: DataFrame, key: str | list[str], how: str, most: int = 500_000) -> DataFrame:
    """left_semi or left_anti join of rows with a table of long ids; the ids are broadcast only if they are at most ``most``."""
    few = ids.count() <= most
    return df.join(F.broadcast(ids) if few else ids, key, how)


def first_by_hash(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of their keys; about twice as many reach the driver, from however many partitions."""
    share = min(1.0, 2.0 * most / max(1, df.count()) + 1e-9)
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    return hashed.where(F.col("_h").cast("double") / F.lit(2.0**64) + 0.5 <= share).orderBy("_h", *keys).limit(most).drop("_h")


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 16) -> DataFrame:
    """Left join with a table that has one row for each of its keys; a hot key is spread by the hash of ``spread``.

    The table isn't broadcast: Spark would judge it by its size without the salts, and the driver would hold it with them.
    """
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(shuffled(many), [*keys, "_salt"], "left").drop("_salt")


def words_of(text: Column) -> Column:
    """Words of a text as an array: runs of anything but ASCII white space. A null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def near_equal_buckets(n_rows: int, rows_each: int = 50_000, most: int = 1 << 16) -> int:
    return max(16, min(most, -(-n_rows // rows_each)))


def hash_bucket(order: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash such that buckets ascend with the hash, taken as a signed number."""
    return F.least(F.lit(buckets - 1), F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * buckets)).cast("int")


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], buckets: int, out: str = "rank", size: str | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Adds the 0-based rank of each row within its keys, by (order, ties), without one task holding a key.

    ``order`` is a 64-bit hash column. Rows of a key are dealt over ``buckets`` ascending ranges of it; the
    bucket totals (at most keys x buckets rows) give each bucket its offset. With ``size``, a column of longs,
    the rank is the sum of the sizes of the rows before instead of their count. ``beside`` is a table with one row
    for each key, whose columns are added; it meets the bucket totals first, so no key is joined in one task, and
    rows without a match in it are left out.
    """
    dealt = df.withColumn("_bucket", hash_bucket(F.col(order), buckets))
    total = F.sum(size).alias("_n") if size else F.count(F.lit(1)).alias("_n")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_bucket").agg(total).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if beside is not None:
        offsets = offsets.join(beside, keys)
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    if size:
        own = F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        own = F.row_number().over(within) - 1
    joined = dealt.withColumn("_own", own.cast("long")).join(offsets, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of an edge table (a, b): rows (node, component), component the least node reachable.

    Alternates large-star and small-star contractions, each one aggregation and one join, until nothing changes;
    every round is written to the shared folder. Nodes without edges are not in the result. Fails if it hasn't
    converged after ``rounds``, which is far more than the logarithm of any number of nodes.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> str:
        df.write.parquet(path := new_folder(spark, "edges"))
        return path

    def with_least(rows: DataFrame, hub: int) -> DataFrame:
        """Rows (a, b, m) with the least b of each a. An a with many rows is a hub; there are so few that they are broadcast."""
        least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        if (least.agg(F.max("n")).first()[0] or 0) <= hub:
            return rows.join(shuffled(least.select("a", "m")), "a")
        hubs = rows.join(F.broadcast(least.where(F.col("n") > hub).select("a", "m")), "a", "left")
        others = hubs.where("m is null").select("a", "b").join(shuffled(least.where(F.col("n") <= hub).select("a", "m")), "a")
        return hubs.where("m is not null").select("a", "b", "m").union(others.select("a", "b", "m"))

    get = lambda path: spark.read.schema("a long, b long").parquet(path)
    here = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # sums of mixed hashes are equal if the edge sets are; they are counted over all rows, so no pair of sets is joined
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first())
    before = sign(get(here))
    for _ in range(rounds):
        now = get(here)
        hub = max(2_000, before[0] // 50_000)  # so there are 100,000 hubs at most
        both = with_least(now.union(now.select("b", "a").toDF("a", "b")), hub)
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        large = get(middle := put(large))
        small = with_least(large, hub)
        # the least neighbour takes the others; each node keeps its edge to it
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        there = put(small)
        after = sign(get(there))
        deleted(spark, here, middle)
        here, same = there, before == after
        before = after
        if same:
            stars = get(here)
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    raise RuntimeError("components did not converge")
