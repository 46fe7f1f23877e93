"""Helpers for plans that must cut lineage or number rows globally.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor can reach, so a lost executor never loses them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one on a local master, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            where = kept.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="sparkward-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkward/{spark.sparkContext.applicationId}"


def cleaned(spark: SparkSession) -> None:
    """Delete what this application has written; nothing made from it can be read afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it read back; ``cleaned`` deletes all such tables."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Short rows dealt out over many tasks, before they are made into much more: a small file is read by one task, however many rows it has."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def broadcast_if_small(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """A table of short rows, broadcast while it has at most ``most`` of them; a join gives the same either way."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "pos") -> tuple[DataFrame, list]:
    """Number the rows of each ``group`` from 0 in ``order``, without gathering a group in one task.

    Rows are range-partitioned by (group, order) and written; a partition then
    holds a contiguous run, so the driver only needs one row for each
    partition and group in it: at most partitions + groups rows. ``group``
    must therefore have a bounded number of values. Returns the numbered
    DataFrame and the list of (group values..., rows).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*group, *order]]
    rows = written(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    )
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    runs = rows.groupBy("__part", *group).agg(F.min("__id").alias("first"), F.count("*").alias("n")).collect()
    totals: dict = {}
    starts = []
    for r in sorted(runs, key=lambda r: r["__part"]):
        g = tuple(r[c] for c in group)
        starts.append((r["__part"], *g, totals.get(g, 0) - r["first"]))
        totals[g] = totals.get(g, 0) + r["n"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(["__part long", *(f"`{c}` {fields[c]}" for c in group), "__shift long"])
    shifts = spark.createDataFrame(starts, ddl)
    out_df = (
        rows.join(F.broadcast(shifts), ["__part", *group])
        .withColumn(out, F.col("__id") + F.col("__shift"))
        .drop("__part", "__id", "__shift")
    )
    return out_df, [(*g, n) for g, n in totals.items()]
