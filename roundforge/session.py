"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def session(name: str = "roundforge", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode, where it may be unset as in tests, a temporary one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="roundforge-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    at, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with place, its rank from 0 by the columns ``order``, which tell all rows apart.

    Rows are dealt out by range and sorted within partitions; the sizes of the partitions, a row for each, are summed up. No task sorts all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number's upper bits are the partition, its lower ones the place there
    rows = checkpointed(rows.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("place", (F.col("__before") + inside).cast("long")).drop("__part", "__at", "__before")
