"""Intermediate tables in the shared folder, and joins whose side is listed or broadcast only after it was counted."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a filter lists, so that it reaches the scan; beyond it a semi join is planned.
LISTED = 4_000
#: Rows of a side that the driver holds and broadcasts; beyond it the join is left to the planner.
LOCAL_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine serves only where all tasks run on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
        folder = spark.sparkContext.getCheckpointDir()
        remove_at_exit(spark, folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The path goes when the driver's JVM ends: plans may read it until then."""
    system, where = file_system(spark, path)
    system.deleteOnExit(where)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, no lineage to lose, removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def one_of(column: str, values: list) -> Column:
    """column IN (values), as one parsed text: thousands of literals a call at a time are slow to hand to the JVM."""
    if not values:
        return F.lit(False)
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"`{column}` IN ({', '.join(quoted(v) if isinstance(v, str) else str(v) for v in values)})")


class Side:
    """The side of a join that names what a query asks for: held by the driver and broadcast if its rows are few, else as it is.

    One look at `LOCAL_ROWS` + 1 rows decides. Rows that occur twice are kept once.
    """

    def __init__(self, df: DataFrame):
        table = df.limit(LOCAL_ROWS + 1).toArrow()
        self.few = table.num_rows <= LOCAL_ROWS
        self.rows = table.to_pylist() if self.few else None
        if self.few:
            plain = not any(pa.types.is_nested(f.type) for f in table.schema)
            table = table.group_by(table.column_names).aggregate([]).select(table.column_names) if plain and table.num_rows else table
            self.frame = F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))
        else:
            self.frame = df.distinct()

    def restrict(self, df: DataFrame, column: str, own: str | None = None) -> DataFrame:
        """Rows of df whose column is among this side's `own` column: a filter that reaches the scan where values are few, else a semi join."""
        own = own or column
        if self.few:
            values = list(dict.fromkeys(r[own] for r in self.rows if r[own] is not None))
            if len(values) <= LISTED:
                return df.where(one_of(column, values))
        return df.join(self.frame.select(F.col(own).alias(column)).distinct(), column, "left_semi")


def restricted(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column is among keys(column)."""
    return Side(keys.select(column)).restrict(df, column)


def small(df: DataFrame) -> DataFrame:
    """df as a broadcast side if its rows are few."""
    return Side(df).frame
