"""Session helpers: reading tables, cutting lineage, size-checked broadcasts, joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only up to this number of rows and this size (Spark's own estimate of its plan, in bytes).
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32_000_000
#: A key with more rows than this is hot and gets salted.
HOT_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the cluster's spark.checkpoint.dir, or in local mode a folder of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, nothing is computed twice, and the loss of an
    executor costs nothing. Unlike an eager checkpoint() the plan runs once. Files are removed when the program ends;
    with `lean`, shuffle files of the plan as soon as it has run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    if lean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if lean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._settled = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(*frames: DataFrame) -> None:
    """Delete the files of settled frames whose readers have all been settled themselves."""
    for df in frames:
        path = getattr(df, "_settled", None)
        entry = next((e for e in _written if e[1] == path), None)
        if entry:
            _written.remove(entry)
            _delete(*entry)


def sweep() -> None:
    """Delete what settle() wrote. Frames built on it can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def wide(spark: SparkSession, least: int = 0) -> int:
    """Partitions for a stage of heavy work on few bytes, which AQE would coalesce too far."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)


def size_of(df: DataFrame) -> int:
    """Bytes of df by Spark's estimate, which for settled frames follows the size of their files; unknown sizes are huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a settled right side: broadcast if its counted rows are at most `most` and its size at most
    BROADCAST_BYTES, else a shuffle join, whose skewed partitions AQE splits."""
    if size_of(right) <= BROADCAST_BYTES and right.count() <= most:
        right = F.broadcast(right)
    return left.join(right, on, how)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, tie: Column, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of left with a right side that has each key once and, in column `rows`, the number of left rows of
    the key. Keys above `hot` rows are spread over rows/hot salts, right rows being repeated once per salt. There are
    at most total/hot such keys, so the list that tells the left side about them is small and is broadcast."""
    salts = F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(hot))).cast("int")
    few = right.where(F.col(rows) > hot).select(key, salts.alias("_salts"))
    if few.isEmpty():
        return left.join(right, key)
    marked = left.join(F.broadcast(few), key, "left").withColumn("_salt", F.pmod(F.xxhash64(tie), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return marked.join(spread, [key, "_salt"]).drop("_salt")
