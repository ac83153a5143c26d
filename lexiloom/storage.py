"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, the one that the context was given; where there is none, one in the warehouse is set, which a cluster's machines share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lexiloom-checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing will read it again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, whatever extra columns it carries."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, label: str) -> DataFrame:
    """Rank rows 1, 2, ... within each group without ever holding a group in one task.

    A range exchange on (group, order) deals rows out evenly however large one
    group is; ties that fill a range are still split by the order's last columns
    as far as those differ. The sorted rows are written once with their position,
    so that a few counts per (partition, group) turn positions into ranks.
    Group columns may be null, and there may be none.
    """
    pid, pos = fresh(df, "__pid"), fresh(df, "__pos")
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in [*group, *order]]
    rows = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(pos, F.monotonically_increasing_id())
    )
    rows = materialize(rows, label)
    names = [f"g{i}" for i in range(len(group))]
    runs = rows.select(F.col(pid).alias("p"), *[F.col(c).alias(n) for c, n in zip(group, names)], F.col(pos).alias("at"))
    runs = runs.groupBy("p", *names).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*names).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1)
    here, there = rows.alias("here"), runs.alias("there")
    same: Column = F.col(f"here.{pid}") == F.col("there.p")
    for c, n in zip(group, names):
        same = same & F.col(f"here.`{c}`").eqNullSafe(F.col(f"there.{n}"))
    place = (F.col(f"here.{pos}") + F.col("there.base")).alias(name)
    return here.join(there, same).select(*[F.col(f"here.`{c}`") for c in df.columns], place)


def placed(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """df with pid and pos, written: rows in ranges of the order, one range a pid, and by pos in order within; neither name may be df's."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(rows.withColumn("pid", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), label)


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, label: str) -> DataFrame:
    """Add the sum of value over all rows up to each, in a unique order; a task sees one range of rows, and one row a range is all that meets."""
    rows = placed(df, order, label)
    sums = rows.groupBy(F.col("pid").alias("of")).agg(F.sum(value).alias("own"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(within)).join(sums, F.col("pid") == F.col("of"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col("base")).alias(name))
