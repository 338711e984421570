"""Tables staged in the folder that all executors share, size checks before a broadcast, and dense row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side of a join is broadcast only after a count showed at most this many (narrow) rows.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) uses a folder below its warehouse; a cluster has no such
    folder that is known to be shared, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Stage:
    """Tables written to the shared folder in one operator run.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the whole job. ``result`` removes
    the tables that the operator's result does not read. The others go when ``clear`` is called, else when the
    driver's JVM ends (Hadoop's delete-on-exit, which works after the session has been stopped).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths) + 1}"
        df.write.parquet(path)
        if not self.paths:
            files, at = _place(self.spark, self.root)
            files.deleteOnExit(at)
            _open_stages(self.spark).append(self.root)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths[id(t)][1])

    def result(self, df: DataFrame, *needed: DataFrame) -> DataFrame:
        keep = {id(t) for t in needed}
        for k, (_, path) in self.paths.items():
            if k not in keep:
                remove(self.spark, path)
        return df


def _open_stages(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_lexispark_stages"):
        sc._lexispark_stages = []
    return sc._lexispark_stages


def remove(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove every staged table of the session; results that read one cannot be read any more."""
    stages = _open_stages(spark)
    while stages:
        remove(spark, stages.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows, else as it is.

    ``df`` should be staged or kept: it is counted here and read again in the join. Beyond the bound the join
    shuffles both sides, and Spark splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ordinals(df: DataFrame, name: str, keys: list[str], order: list[str], stage: Stage, tie: str | None = None) -> DataFrame:
    """``df`` with a dense number from 0 in each group of ``keys``, in the order of ``order``.

    Rows are dealt by ranges of (keys, order), so a group of any size is numbered by many tasks: each row's place in
    its range, after the count of the group's rows in the ranges before. Equal rows of ``order`` are dealt by a
    number of their own, so repeats do not meet in one task; ``tie`` names it if a staged ``df`` has one already. Carry
    only the columns that are needed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in df.columns if c != tie]
    rows = df.withColumnRenamed(tie, "_tie") if tie else stage.table(df.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(parts, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie")
    dealt = stage.table(dealt.drop("_tie").withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] + [F.col(f"{a}._p") == F.col(f"{b}._p")]
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))  # a row for each group and task
    sizes = stage.table(sizes.select(*keys, "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add")))
    out = dealt.alias("d").join(small(sizes).alias("s"), same("d", "s"))
    return out.select(*[F.col(f"d.{c}") for c in columns], (F.col("_m") + F.col("_add")).cast("long").alias(name))
