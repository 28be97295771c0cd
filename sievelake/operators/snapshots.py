"""Weekly snapshots in partitions: rebuilding some weeks replaces those partitions and touches no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000


def monday(at: Column) -> Column:
    return F.date_format(F.date_trunc("WEEK", at), "yyyy-MM-dd")


def by_week(rows: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Each row once for each ``week_start`` (Monday) in whose window it lies: the ``days`` up to the end of that week. At most days / 7 + 1 copies, so all weeks come from
    one scan; rows without a time lie in none."""
    first = F.date_trunc("WEEK", F.col(at).cast("timestamp"))
    last = F.col(at).cast("timestamp") + F.make_dt_interval(days=F.lit(days - 7))
    # a window ends on its week's Sunday at midnight and begins ``days`` before: the last week that still holds the row starts before ``last``
    weeks = F.sequence(first.cast("date"), F.date_trunc("WEEK", last).cast("date"), F.expr("interval 7 days"))
    inside = F.filter(weeks, lambda w: F.unix_micros(w.cast("timestamp")) + (7 - days) * DAY <= F.unix_micros(F.col(at).cast("timestamp")))
    return rows.where(F.col(at).isNotNull()).withColumn("week_start", F.explode(inside)).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


def replace_weeks(rows: DataFrame, path: str, weeks: list[str], column: str = "week_start") -> None:
    """Writes the rows of ``weeks`` (partitions of ``column``) in the place of what the table has for them; a week without rows is emptied, other weeks stay as they are.

    The write overwrites partitions by name, so a run that is repeated leaves the same table. Rows of other weeks are an error of the caller and left out.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(column).isin(*weeks)) if weeks else rows.limit(0)
    own.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    found = {r[0] for r in weeks_of(spark, path, column, rows).where(F.col(column).isin(*weeks)).distinct().collect()} if weeks else set()
    written = {r[0] for r in own.select(column).distinct().collect()}  # as many as weeks were asked for
    for week in found - written:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={week}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def weeks_of(spark: SparkSession, path: str, column: str, like: DataFrame) -> DataFrame:
    return read_weeks(spark, path, like, column).select(column)


def read_weeks(spark: SparkSession, path: str, like: DataFrame, column: str = "week_start") -> DataFrame:
    """The table, with the columns of ``like``; the partition is text."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)
