"""Lookups, ranges and changes of tables by a key column. All functions take and give DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import number, stripped
from quillon.runtime import stage

#: Names a table's access kind can be given by, and the kind.
KINDS = {
    "seq": "sequential", "sequential": "sequential", "isam": "isam", "hash": "hash",
    "btree": "btree", "bplustree": "btree", "rtree": "rtree",
}


def resolve(df: DataFrame, column: str | int) -> str:
    """The column a name or ordinal means: exact, then without regard to case, then by position."""
    text = str(column).strip()
    if text in df.columns:
        return text
    for name in df.columns:
        if name.strip().lower() == text.lower():
            return name
    if text.isdigit() and int(text) < len(df.columns):
        return df.columns[int(text)]
    raise ValueError(f"no column {column!r} among {df.columns}")


def col_of(df: DataFrame, column: str | int) -> Column:
    """A column by name or ordinal."""
    return F.col(f"`{resolve(df, column)}`")


#: Columns a written layout has besides the table's own: the key as stripped text, as a number, its bucket, its place on a curve.
KEY, NUMBER, BUCKET, CURVE = "_q_key", "_q_number", "_q_bucket", "_q_curve"


def _curve(lat: Column, lon: Column) -> Column:
    """The place on a Z-order curve over the globe, so that rows next to each other in a file lie next to each other on it."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    step = lambda c, top: F.floor((c + top) / (2 * top) * 65535).cast("long")
    return F.shiftleft(spread(step(lat, 90.0)), 1).bitwiseOR(spread(step(lon, 180.0)))


def stored(df: DataFrame, kind: str, key: str, buckets: int = 64, arrange: bool = True) -> DataFrame:
    """The table written in the layout of its kind and read back, with helper columns for :func:`narrowed`.

    A hash has a folder a bucket, which an equality prunes to one; sequential, isam and btree are ranged and sorted by the key, and
    rtree (``key`` names latitude and longitude) by a curve over the globe, so that the statistics of row groups rule out nearly all of them. Without
    ``arrange`` rows are written as they come, as for a few that are added.
    """
    if kind == "rtree":
        lat, lon = key.split(",")
        out, order = df.withColumn(CURVE, _curve(F.col(f"`{lat}`"), F.col(f"`{lon}`"))), [F.col(CURVE)]
    else:
        c = col_of(df, key)
        out, order = df.withColumn(KEY, stripped(c)), [F.col(KEY)]
        if kind == "btree":
            out = out.withColumn(NUMBER, number(c) if dict(df.dtypes)[resolve(df, key)] == "string" else c.try_cast("double"))
            order = [F.col(NUMBER).asc_nulls_last(), F.col(KEY)]
        elif kind == "hash":
            out = out.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
    if arrange:
        out = out.repartition(BUCKET) if kind == "hash" else out.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(out, kind, [BUCKET] if kind == "hash" else [])


def narrowed(df: DataFrame, key: str | None, column: str | int, value: Any, high: Any = None, buckets: int = 64) -> DataFrame:
    """The rows of a layout that can equal the value, or lie from it to ``high``; all of them where the layout cannot tell.

    Only plain comparisons with literals, which prune folders and reach the scan.
    """
    if key is None or resolve(df, column) != key:
        return df
    kind = dict(df.dtypes)[key]
    try:
        numbers = [float(str(v).strip()) for v in (value, value if high is None else high)]
    except ValueError:
        numbers = None
    if NUMBER in df.columns and numbers:
        return df.filter(F.col(NUMBER).between(*numbers))
    if high is None and KEY in df.columns and (kind == "string" or isinstance(value, str) or isinstance(value, int) and kind in ("int", "bigint", "smallint", "tinyint")):
        df = df.filter(F.col(KEY) == str(value).strip())
        return df.filter(F.col(BUCKET) == F.pmod(F.xxhash64(F.lit(str(value).strip())), F.lit(buckets)).cast("int")) if BUCKET in df.columns else df
    return df


def scan(df: DataFrame, kind: str = "hash", key: str | int | None = None) -> DataFrame:
    """All rows, in key order where the kind has one."""
    if kind in ("sequential", "isam") and key is not None:
        return df.orderBy(col_of(df, key).cast("string"))
    if kind == "btree" and key is not None:
        c = col_of(df, key)
        return df.orderBy(number(c).asc_nulls_last(), c.cast("string"))
    return df


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the order asked for; a name the table lacks gives an empty string."""
    found = {n.lower(): n for n in df.columns}
    return df.select(*[F.col(f"`{found[n.lower()]}`").alias(n) if n.lower() in found else F.lit("").alias(n) for n in names])


def equal(df: DataFrame, column: str | int, value: Any) -> DataFrame:
    """Rows whose stripped text equals the stripped value; nulls never do."""
    c = col_of(df, column)
    if dict(df.dtypes)[resolve(df, column)] in ("string",):
        return df.filter(stripped(c) == str(value).strip())
    return df.filter(c == F.lit(value)) if not isinstance(value, str) else df.filter(c.cast("string") == value.strip())


def equal_number(df: DataFrame, column: str | int, value: Any) -> DataFrame:
    """Rows equal as numbers where both are ('5' and '05'), else as stripped strings."""
    c = col_of(df, column)
    try:
        wanted = float(str(value).strip())
    except ValueError:
        return df.filter(stripped(c) == str(value).strip())
    if dict(df.dtypes)[resolve(df, column)] != "string":
        return df.filter(c == F.lit(wanted))
    return df.filter(number(c) == F.lit(wanted))


def between_numbers(df: DataFrame, column: str | int, low: Any, high: Any) -> DataFrame:
    """Rows from low to high, both in, as numbers, in key order. A value that is no number is in no numeric range."""
    c = col_of(df, column)
    key = c if dict(df.dtypes)[resolve(df, column)] != "string" else number(c)
    return df.filter(key.between(F.lit(float(low)), F.lit(float(high)))).orderBy(key)


def between_strings(df: DataFrame, column: str | int, low: Any, high: Any) -> DataFrame:
    """Rows from low to high, both in, compared as strings, in key order."""
    c = col_of(df, column).cast("string")
    return df.filter(c.between(F.lit(str(low)), F.lit(str(high)))).orderBy(c)


def in_range(df: DataFrame, kind: str, column: str | int, low: Any, high: Any) -> DataFrame:
    """The range search of an access kind; a hash has none."""
    if kind == "hash":
        raise ValueError("a hash table has no range search")
    return between_numbers(df, column, low, high) if kind == "btree" else between_strings(df, column, low, high)


def insert(df: DataFrame, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """The table with rows added at its end, each value cast to its column; short rows are filled with nulls, long ones refused."""
    width = len(df.columns)
    if any(len(r) > width for r in rows):
        raise ValueError(f"a row has more than {width} values")
    filled = [tuple(None if v is None else str(v) for v in [*r, *[None] * (width - len(r))]) for r in rows]
    names = [f"_{k}" for k in range(width)]
    added = df.sparkSession.createDataFrame(filled, ", ".join(f"{n} string" for n in names))
    return df.unionByName(added.select(*[F.col(n).cast(t).alias(c) for n, (c, t) in zip(names, df.dtypes, strict=True)]))


def _matches(df: DataFrame, column: str | int, value: Any, kind: str) -> Column:
    c = col_of(df, column)
    text = dict(df.dtypes)[resolve(df, column)] == "string"
    if kind == "btree":
        try:
            return (number(c) if text else c) == F.lit(float(str(value).strip()))
        except ValueError:
            pass
    return stripped(c) == str(value).strip()


def delete(df: DataFrame, column: str | int, value: Any, kind: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) rows; a null key is kept."""
    hit = F.coalesce(_matches(df, column, value, kind), F.lit(False))
    return df.filter(~hit), df.filter(hit)


def page(df: DataFrame, order: Sequence[Column], number_of: int, size: int = 100) -> DataFrame:
    """One page of an ordered table; pages count from 0."""
    return df.orderBy(*order).offset(number_of * size).limit(size)


def layout_stats(df: DataFrame) -> DataFrame:
    """(partition, n): how many rows each bucket, or else each file, of a written layout holds, files numbered in order of their names."""
    if BUCKET in df.columns:
        return df.groupBy(F.col(BUCKET).alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    files = df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.select((F.row_number().over(Window.orderBy("file")) - 1).alias("partition"), "n")  # a row a file
