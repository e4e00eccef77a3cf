"""Mixing sources to target weights under repetition limits.

Weights lie on a temperature path between what the sources could give and what is asked:
with ``s`` a source's share of all available tokens (its size times its repetition
limit) and ``w`` its target weight, ``p ~ s**(1 - t) * w**t``. At t = 1 the targets
hold; the exponent is bisected for the largest t at which no source is
repeated more often than allowed. Without targets, ``p ~ size**t`` and t is
bisected for a wanted entropy. The weights become budgets of tokens, and each
source meets its budget with whole passes and one budgeted part of a permutation of
its blocks.

The total is free or given. Free, it is the most at which the targets hold: t is 1, and what
the scarcest source cannot keep up with is left out. Given, t gives way instead of the total.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import count_tokens
from quillon.runtime import stage


def _bisect(good: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The largest value from ``low`` (taken as good) to ``high`` up to which ``good`` holds."""
    if good(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def _normalised(logs: Mapping[str, float]) -> dict[str, float]:
    top = max(logs.values())
    raised = {k: math.exp(v - top) for k, v in logs.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(weights: Mapping[str, float]) -> float:
    """Entropy in nats."""
    return -sum(p * math.log(p) for p in weights.values() if p > 0)


def tempered(sizes: Mapping[str, float], target_entropy: float) -> tuple[float, dict[str, float]]:
    """(t, weights) with weights ~ size**t of the wanted entropy, t in 0..64; sources of size 0 get none."""
    logs = {k: math.log(v) for k, v in sizes.items() if v > 0}
    if not logs:
        return 0.0, {}
    at = lambda t: _normalised({k: t * v for k, v in logs.items()})
    t = _bisect(lambda t: entropy(at(t)) >= target_entropy, 0.0, 64.0)
    return t, at(t)


def limited(sizes: Mapping[str, float], targets: Mapping[str, float], repeats: Mapping[str, int], total: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(t, total, weights): weights as near to the targets as the repetition limits let them be at ``total`` tokens.

    Without ``total``, it is the most at which the targets themselves hold (t = 1).
    Sources without tokens, target or repetitions take no part.
    """
    room = {k: sizes.get(k, 0) * repeats.get(k, 0) for k in targets if targets[k] > 0}
    room = {k: v for k, v in room.items() if v > 0}
    if not room:
        return 1.0, 0.0, {}
    want = _normalised({k: math.log(targets[k]) for k in room})
    share = _normalised({k: math.log(v) for k, v in room.items()})
    if total is None:
        return 1.0, min(room[k] / want[k] for k in room), want
    total = min(total, sum(room.values()))
    at = lambda t: _normalised({k: (1 - t) * math.log(share[k]) + t * math.log(want[k]) for k in room})
    t = _bisect(lambda t: all(p * total <= room[k] * (1 + 1e-9) for k, p in at(t).items()), 0.0, 1.0)
    return t, total, at(t)


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, underscores."""
    return F.translate(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "- ", "__")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): documents of a known source with their tokens; staged. Texts without tokens stay out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source_name(F.col(f"`{source_col}`")).alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("id is not null and source is not null and text is not null and text <> ''")
    return stage(count_tokens(rows, "text", "size").select("id", "source", "size"), "sized")


def plan(documents: DataFrame, targets: DataFrame, total: float | str | None = None) -> DataFrame:
    """(mix_name, source, target_share, exponent, weight, budget, passes, part, blocks): the budgets of each mix.

    Only one row per listed source comes to the driver. A mix and a source listed
    twice have their weights added and keep the smaller limit; null or negative
    weights and limits count as 0. A ``total`` of ``"held"`` is for each mix what its sources
    hold, those with a weight and a limit above 0.
    """
    listed = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_weight", "max_repeats")
    listed = listed.groupBy("mix_name", "source").agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"),
    )
    sizes = documents.join(listed.select("source").distinct(), "source", "left_semi")
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    wanted = listed.join(sizes, "source", "left").select("mix_name", "source", "weight", "repeats", "tokens", "docs").collect()
    rows = []
    for mix in sorted({r["mix_name"] for r in wanted}, key=str):
        own = {r["source"]: r for r in wanted if r["mix_name"] == mix}
        weights = {k: float(r["weight"]) for k, r in own.items()}
        size = {k: float(r["tokens"] or 0) for k, r in own.items()}
        held = sum(size[k] for k, r in own.items() if weights[k] > 0 and r["repeats"] > 0)
        t, most, share = limited(size, weights, {k: r["repeats"] for k, r in own.items()}, held if total == "held" else total)
        asked = sum(weights.values())
        for k, r in own.items():
            budget = math.floor(share.get(k, 0.0) * most + 1e-6)
            whole = min(int(budget // size[k]), r["repeats"]) if size[k] else 0
            part = int(budget - whole * size[k]) if whole < r["repeats"] else 0
            blocks = min(1 << 16, max(1, (r["docs"] or 0) // 256))
            rows.append((mix, k, weights[k] / asked if asked else 0.0, t, share.get(k, 0.0), budget, whole, part, blocks))
    schema = "mix_name string, source string, target_share double, exponent double, weight double, budget long, passes int, part long, blocks int"
    return documents.sparkSession.createDataFrame(rows, schema)


def mix(documents: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """(mix_name, source, id, size, copies): how often each document is taken, those taken at all.

    Every source is permuted by a hash: documents into blocks, blocks by number. The
    part of a pass takes documents in this order, leaving out each that does not fit what is left of
    its budget; see :func:`_stretches`. No source is ever sorted as a whole.
    """
    used = planned.filter("passes > 0 or part > 0").select("mix_name", "source", "passes", "part", "blocks")
    rows = documents.join(used, "source")
    chance = F.xxhash64("mix_name", "source", "id", F.lit(seed))
    rows = rows.withColumn("chance", chance).withColumn("at", F.struct(F.pmod("chance", F.col("blocks")).alias("block"), "chance", "id"))
    stretches = _stretches(rows, used)
    taken = F.exists("stretches", lambda s: (F.col("size") <= s["room"]) & (s["after"].isNull() | (F.col("at") > s["after"])) & (s["until"].isNull() | (F.col("at") < s["until"])))
    every = rows.join(F.broadcast(stretches), ["mix_name", "source"], "left")
    every = every.withColumn("copies", F.col("passes") + F.coalesce(taken, F.lit(False)).cast("int"))
    return every.filter("copies > 0").select("mix_name", "source", "id", "size", "copies")


def _stretches(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(mix_name, source, stretches): between ``after`` and ``until`` the part takes all documents of at most ``room`` tokens.

    A stretch ends at the first document that would fit by itself but not behind those before it;
    the next has the budget that is left. In a stretch whole blocks are added up, and single
    documents only in the block in which it ends. Rounds end when nothing more is in the way. The driver
    sees a row per listed source and round.
    """
    spark, key = rows.sparkSession, ["mix_name", "source"]
    place = rows.schema["at"].dataType.simpleString()
    room = {(r["mix_name"], r["source"]): r["part"] for r in used.filter("part > 0").select(*key, "part").collect()}
    after = dict.fromkeys(room)
    open_, found = set(room), {k: [] for k in room}
    while open_:
        bounds = spark.createDataFrame([(*k, room[k], after[k]) for k in open_], f"mix_name string, source string, room long, after {place}")
        fit = rows.join(F.broadcast(bounds), key).filter("size <= room and (after is null or at > after)")
        sums = fit.groupBy(*key, "room", F.col("at.block").alias("block")).agg(F.sum("size").alias("held"))
        ahead = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0))).filter("before <= room and before + held > room")
        last = fit.withColumn("block", F.col("at.block")).join(F.broadcast(sums.select(*key, "block", "before")), [*key, "block"])
        # documents at one place, the same id twice, are taken or left together
        run = F.col("before") + F.sum("size").over(Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ends = last.withColumn("run", run).groupBy(*key).agg(
            F.min(F.when(F.col("run") > F.col("room"), F.col("at"))).alias("until"),
            F.coalesce(F.max(F.when(F.col("run") <= F.col("room"), F.col("run"))), F.first("before")).alias("taken"),
        )
        ended = {(r["mix_name"], r["source"]): r for r in ends.collect()}
        for k in open_:
            until = ended[k]["until"] if k in ended else None
            found[k].append((room[k], after[k], until))
            if k in ended:
                room[k], after[k] = room[k] - ended[k]["taken"], until
        open_ = {k for k in open_ if k in ended and room[k] > 0}
    return spark.createDataFrame([(*k, v) for k, v in found.items()], f"mix_name string, source string, stretches array<struct<room:bigint,after:{place},until:{place}>>")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, docs, max_copies, exponent): what each mix reached.

    Every listed source has a row; one without documents, weight or repetitions has an actual share of 0.
    """
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("max_copies")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = planned.join(got, ["mix_name", "source"], "left")
    rows = rows.select("mix_name", "source", "target_share", zero("tokens"), zero("docs"), zero("max_copies"), "exponent")
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    actual = F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0))
    return rows.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), F.round(actual, 6).alias("actual_share"), "tokens", "docs", "max_copies", F.round("exponent", 6).alias("exponent"))


def mixed_documents(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and the shares it reached, straight from documents and targets; see :func:`mix` and :func:`shares`.

    Sources are matched without regard to letter case, outer blanks and hyphens. Documents
    with a null source, null or empty text are in no mix; an empty table gives empty mixes.
    """
    documents = sized(docs, id_col, text_col, source_col)
    planned = plan(documents, targets, total)
    mixed = stage(mix(documents, planned), "mix")
    return mixed.withColumnRenamed("id", id_col), shares(mixed, planned)
