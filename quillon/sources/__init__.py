"""Readers and writers of tables and files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import basename


def read_csv(spark: SparkSession, path: str, *, typed: bool = False, encoding: str = "UTF-8", sep: str = ",", tolerant: bool = False, multiline: bool = True) -> DataFrame:
    """A CSV file with a header line; quoted line breaks are kept within their field.

    A file whose fields hold no line break can be read in parts, by many tasks, with ``multiline`` off; else a file is one task.

    All columns are strings, with empty cells as '' and missing ones as '' too, or
    ``typed`` by their contents. ``tolerant`` drops malformed rows; else they load with
    the cells they have.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("quote", '"')
    reader = reader.option("encoding", encoding).option("sep", sep).option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE")
    df = reader.option("inferSchema", typed).csv(path)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.strip()])
    return df if typed else df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file of one JSON object a line."""
    return spark.read.json(path)


def from_rows(spark: SparkSession, rows: Sequence[Any], names: Sequence[str] | None = None) -> DataFrame:
    """A table of dicts or lists given in memory; list columns without names are ``col0``, ``col1``, ..."""
    if not rows:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names or ["col0"]]))
    if isinstance(rows[0], dict):
        keys = names or list(dict.fromkeys(k for r in rows for k in r))
        return spark.createDataFrame([[r.get(k) for k in keys] for r in rows], list(keys))
    width = max(len(r) for r in rows)
    names = list(names or [f"col{k}" for k in range(width)])
    return spark.createDataFrame([[*r, *[None] * (width - len(r))] for r in rows], names)


def from_embeddings(spark: SparkSession, vectors: Sequence[Sequence[float]], metadata: Sequence[dict] | None = None) -> DataFrame:
    """(id, embedding, metadata columns) of vectors given in memory."""
    rows = [{"id": k, "embedding": [float(x) for x in v], **(metadata[k] if metadata else {})} for k, v in enumerate(vectors)]
    return from_rows(spark, rows)


def read_files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """(path, name, subdirectory, size_mb, modified[, content]) of the files below a folder.

    Without content only names and sizes are read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    columns = [
        F.col("path"), basename(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -2).alias("subdirectory"),
        F.round(F.col("length") / (1024 * 1024), 3).alias("size_mb"), F.col("modificationTime").alias("modified"),
    ]
    return files.select(*columns, *([F.col("content")] if content else []))


def write_csv(df: DataFrame, path: str) -> None:
    """Write as CSV with a header line; quotes are doubled."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write as one JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv_line(*columns: Column) -> Column:
    """Values as one CSV line, quoted where they hold a comma, quote, blank or line break."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike(r'[," \n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def series(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    """Rows with ``id`` from 1 to n and further columns from expressions over it."""
    return spark.range(1, n + 1).select("id", *[c.alias(name) for name, c in columns.items()])


def example_products(spark: SparkSession, n: int = 100) -> DataFrame:
    """Invented shelf goods (id, name, category, price, rating, description), the same on every run."""
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000)) / 1000
    colour, thing = pick(1, ("red", "green", "slate", "ivory", "plain")), pick(2, ("lamp", "kettle", "stool", "basket", "clock", "rug"))
    return series(
        spark, n,
        name=F.concat_ws(" ", colour, thing, F.col("id")),
        category=pick(3, ("kitchen", "light", "floor")),
        price=F.round(4 + 196 * share(4) * share(5), 2),
        rating=F.round(5 - 3 * share(6) * share(7), 1),
        description=F.concat(F.lit("A "), colour, F.lit(" "), thing, F.lit(" for the house")),
    )
