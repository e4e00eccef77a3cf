"""Loading delimited records strictly, with the rows that fail and why.

Raw records keep their offset. The strict load takes only records that conform;
subtracting their offsets from those of all records leaves the ones that
failed, and only these are diagnosed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reasons for failure, in the order in which they are looked for.
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"
_ESCAPE, _SEPARATOR = "\x01e", "\x01s"


@dataclass(frozen=True)
class Format:
    """Fields of a record and what each must hold.

    ``patterns`` are regular expressions a whole value must match, ``vocabularies``
    name the fields whose values come from a table of allowed ones, and
    ``optional`` those among them that may be empty; ``types`` are SQL types of the loaded columns.
    """

    fields: Sequence[str]
    patterns: Mapping[str, str] = field(default_factory=dict)
    vocabularies: Sequence[str] = ()
    optional: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)


def split_quotes(raw: Column) -> Column:
    """The parts between quotation marks: those at even places lie outside of quotes."""
    return F.split(raw, '"', -1)


def quoting_ok(raw: Column) -> Column:
    """Whether every field is wholly quoted, inner quotes doubled, or holds no quote at all."""
    parts = split_quotes(raw)
    last = F.size(parts) - 1

    def outside(part: Column, at: Column) -> Column:
        starts, ends = (at == 0) | part.startswith(","), (at == last) | part.endswith(",")
        # an empty part between two quotes is a doubled quote
        return (at % 2 == 1) | (part == "") | (starts & ends)

    checked = F.forall(F.transform(parts, outside), lambda ok: ok)
    return (last % 2 == 0) & checked


def values(raw: Column) -> Column:
    """The fields of a record whose quoting is right, without their quotes."""
    parts = split_quotes(F.replace(raw, F.lit("\x01"), F.lit(_ESCAPE)))
    last = F.size(parts) - 1

    def part_of(part: Column, at: Column) -> Column:
        doubled = (part == "") & (at > 0) & (at < last)
        return F.when(at % 2 == 1, part).when(doubled, F.lit('"')).otherwise(F.replace(part, F.lit(","), F.lit(_SEPARATOR)))

    joined = F.array_join(F.transform(parts, part_of), "")
    return F.transform(F.split(joined, _SEPARATOR, -1), lambda v: F.replace(v, F.lit(_ESCAPE), F.lit("\x01")))


def _judged(raw: DataFrame, offset: str, text: str, fmt: Format, allowed: DataFrame | None) -> DataFrame:
    """(offset, mark, shaped, fields, valid) of each record."""
    line = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = raw.select(F.col(f"`{offset}`").alias("_offset"), F.xxhash64(F.col(f"`{text}`")).alias("_mark"), line.alias("_line"))
    rows = rows.withColumn("_quoted", quoting_ok(F.col("_line")))
    rows = rows.withColumn("_fields", F.when(F.col("_quoted"), values(F.col("_line"))))
    rows = rows.withColumn("_shaped", F.col("_quoted") & (F.size("_fields") == len(fmt.fields)))
    valid = F.lit(True)
    for k, name in enumerate(fmt.fields):
        value = F.try_element_at(F.col("_fields"), F.lit(k + 1))
        if name in fmt.patterns:
            valid &= value.rlike(rf"\A(?:{fmt.patterns[name]})\z")
        if name in fmt.vocabularies:
            words = allowed.filter(F.col("field_name") == name).select(F.col("allowed_value").alias("_word")).distinct()
            rows = rows.withColumn("_value", value).join(words.withColumn("_known", F.lit(True)), F.col("_value") == F.col("_word"), "left")
            known = F.coalesce("_known", F.lit(False))
            rows = rows.withColumn(f"_ok_{k}", known | (value == "") if name in fmt.optional else known).drop("_word", "_known", "_value")
            valid &= F.col(f"_ok_{k}")
    return rows.withColumn("_valid", F.coalesce(F.col("_shaped") & valid, F.lit(False)))


def strict_load(raw: DataFrame, offset: str, text: str, fmt: Format, allowed: DataFrame | None = None) -> DataFrame:
    """(offset, one typed column per field) of the records that conform.

    Empty values become null in typed columns and stay empty in string columns. A
    record that comes twice is loaded twice. ``allowed`` has (field_name, allowed_value).
    """
    good = _judged(raw, offset, text, fmt, allowed).filter("_valid")
    columns = []
    for k, name in enumerate(fmt.fields):
        value = F.element_at("_fields", k + 1)
        kind = fmt.types.get(name, "string")
        columns.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return good.select(F.col("_offset").alias(offset), "_mark", *columns)


def failures(raw: DataFrame, offset: str, text: str, fmt: Format, allowed: DataFrame | None = None) -> DataFrame:
    """(offset, raw record, reason): records the strict load left out, with the first reason that holds.

    All records minus the loaded ones by offset (and content, so that a
    repeated or null offset cannot hide a failure). A null record has no
    fields and fails for its column count. Extra columns are ignored.
    """
    loaded = strict_load(raw, offset, text, fmt, allowed).select(F.col(offset).alias("_o"), F.col("_mark").alias("_m"))
    line = F.col(f"`{text}`")
    every = raw.select(F.col(f"`{offset}`").alias(offset), line.alias(text), F.xxhash64(line).alias("_mark"))
    rest = every.join(loaded, F.col(offset).eqNullSafe(F.col("_o")) & (F.col("_mark") == F.col("_m")), "left_anti")
    quoted = quoting_ok(F.coalesce(F.col(text), F.lit("")))
    count = F.when(quoted, F.size(values(F.coalesce(F.col(text), F.lit("")))))
    reason = F.when(~quoted, QUOTING).when(count != len(fmt.fields), COLUMN_COUNT).otherwise(INVALID_VALUE)
    return rest.select(offset, text, reason.alias("reason"))


def reason_counts(failed: DataFrame) -> DataFrame:
    """(reason, n): how many records failed for which reason."""
    return failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: The format of the product styles file.
STYLES = Format(
    fields=("id", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "productDisplayName"),
    patterns={
        "id": "[0-9]{1,9}",
        "year": "|20[01][0-9]|202[0-6]",
        "productDisplayName": r"(?s).*[^\s\p{Z}].*",
    },
    vocabularies=("gender", "season"),
    optional=("season",),
    types={"id": "int", "year": "int"},
)
