"""Joins, counts and set operations used to prepare tables and to compare results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import basename


def joined(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join on equal keys."""
    return left.join(right, on, "inner")


def looked_up(rows: DataFrame, table: DataFrame, row_path: str, table_path: str, value: str, suffix: str = "") -> DataFrame:
    """``rows`` with ``value`` of the table's row of the same path, else of the same file name, else of that name with a suffix."""
    by = table.select(F.col(f"`{table_path}`").alias("_p"), basename(F.col(f"`{table_path}`")).alias("_b"), F.col(f"`{value}`").alias("_v"))
    full = by.groupBy("_p").agg(F.min("_v").alias("_full"))
    base = by.groupBy("_b").agg(F.min("_v").alias("_base"))
    out = rows.join(full, F.col(f"`{row_path}`") == F.col("_p"), "left").drop("_p")
    out = out.join(base, basename(F.col(f"`{row_path}`")) == F.col("_b"), "left").drop("_b")
    found = F.coalesce("_full", "_base")
    if suffix:
        more = base.select(F.col("_b").alias("_s"), F.col("_base").alias("_suffixed"))
        out = out.join(more, F.concat(basename(F.col(f"`{row_path}`")), F.lit(suffix)) == F.col("_s"), "left").drop("_s")
        found = F.coalesce("_full", "_base", "_suffixed")
    return out.withColumn(value, found).drop("_full", "_base", "_suffixed")


def present(rows: DataFrame, files: DataFrame, path: str, file_path: str = "path") -> DataFrame:
    """Rows whose file exists in a listing."""
    return rows.filter(F.col(f"`{path}`").isNotNull()).join(files.select(F.col(f"`{file_path}`").alias(path)), path, "left_semi")


def missing(rows: DataFrame, table: DataFrame, path: str, table_path: str) -> DataFrame:
    """Rows found in the table neither by path nor by file name."""
    names = table.select(F.col(f"`{table_path}`").alias("_p")).filter("_p is not null")
    rest = rows.join(names, F.col(f"`{path}`") == F.col("_p"), "left_anti")
    return rest.join(names.select(basename(F.col("_p")).alias("_b")).distinct(), basename(F.col(f"`{path}`")) == F.col("_b"), "left_anti")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n), most frequent first, ties by value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())
    return counted.limit(top) if top else counted


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, n_distinct, low, high, mean of a column."""
    c = F.col(f"`{column}`")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(c).alias("n_distinct"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 6).alias("mean")
    )


def path_shapes(df: DataFrame, path: str) -> DataFrame:
    """(shape, n): paths counted by number of parts, first part and last part's suffix left in place."""
    parts = F.split(F.col(f"`{path}`"), "/")
    shape = F.concat(F.size(parts).cast("string"), F.lit(" parts: "), F.element_at(parts, 1))
    return df.filter(F.col(f"`{path}`").isNotNull()).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, mean, deviation): per-element mean and population deviation of an array column."""
    rows = df.select(F.posexplode(F.col(f"`{vector}`").cast("array<double>")).alias("dim", "x"))
    return rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def union(*parts: DataFrame) -> DataFrame:
    """All rows of several tables."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def distinct_union(*parts: DataFrame) -> DataFrame:
    """The different rows of several tables."""
    return union(*parts).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different rows of the first table the second lacks."""
    return left.distinct().exceptAll(right.distinct())


def overlap(left: DataFrame, right: DataFrame, key: str, rank: str, tops: Sequence[int] = (5, 10)) -> DataFrame:
    """One row comparing two ranked results: sizes, intersection, union, jaccard, overlap at each top."""
    a = left.select(F.col(key).alias("k"), F.col(rank).alias("ra")).groupBy("k").agg(F.min("ra").alias("ra"))
    b = right.select(F.col(key).alias("k"), F.col(rank).alias("rb")).groupBy("k").agg(F.min("rb").alias("rb"))
    both = a.join(b, "k", "full")
    has_a, has_b = F.col("ra").isNotNull(), F.col("rb").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    inter, every = n(has_a & has_b), F.count(F.lit(1))
    return both.agg(
        n(has_a).alias("n_left"), n(has_b).alias("n_right"), inter.alias("n_both"), every.alias("n_either"),
        F.round(F.when(every > 0, inter / every).otherwise(F.lit(0.0)), 6).alias("jaccard"),
        *[n((F.col("ra") <= t) & (F.col("rb") <= t)).alias(f"overlap_at_{t}") for t in tops],
    )
