"""Near-duplicate records: exact similarity join on word sets, pairs and groups.

The join works on classes of records with equal word sets. Candidate regions
come from min-wise hashing (see README for why Voronoi regions of document
pivots cannot separate anything at this similarity), each region is joined
by itself, and every pair that leaves a region is checked exactly on its words.
A region that outgrows ``block`` rows is split into blocks which are joined
pairwise in tasks of their own, so no region is ever held whole and none is cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import stage

#: Fixed value: what separates words, maximal runs of letters and digits.
WORD_BREAK = r"[^\p{L}\p{N}]+"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_sets(df: DataFrame, id_col: str, text_cols: Sequence[str], min_words: int) -> DataFrame:
    """(id, words, n): distinct words of each record with at least ``min_words`` of them."""
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in text_cols]))
    words = F.array_remove(F.array_distinct(F.split(text, WORD_BREAK)), "")
    sets = df.select(F.col(f"`{id_col}`").alias("id"), words.alias("words")).filter("id is not null")
    return sets.withColumn("n", F.size("words")).filter(F.col("n") >= min_words)


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, count, dtype=np.uint64)


def _sketcher(bands: int, rows: int, seed: int):
    """Words as 64-bit hashes -> region keys and a parity bitmap of 128 bits.

    A word flips one bit of the bitmap, so two bitmaps differ in no more bits
    than their word sets differ in words: a lower bound that never drops a pair.
    """
    odd, add = _family(bands * rows, seed)
    fold, _ = _family(rows, seed + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed = batch.column("hashes")
            at = hashed.offsets.to_numpy()[:-1] - hashed.offsets[0].as_py()
            flat = hashed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            flat ^= flat >> np.uint64(32)
            keys = np.empty((batch.num_rows, bands), np.uint64)
            for b in range(bands):
                key = np.full(batch.num_rows, b + 1, np.uint64)
                for r in range(rows):
                    k = b * rows + r
                    low = np.minimum.reduceat(flat * odd[k] + add[k], at)
                    key = (key ^ (low >> np.uint64(7))) * fold[r]
                    key ^= key >> np.uint64(31)
                keys[:, b] = key
            bit = np.uint64(1) << (flat & np.uint64(63))
            high = (flat >> np.uint64(6)) & np.uint64(1)
            zero = np.uint64(0)
            one = np.bitwise_xor.reduceat(np.where(high == 0, bit, zero), at)
            two = np.bitwise_xor.reduceat(np.where(high == 1, bit, zero), at)
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("set_key"),
                    batch.column("n"),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
                ],
                ["id", "set_key", "n", "b0", "b1", "keys"],
            )

    return run


def _close(x: dict, i: np.ndarray, y: dict, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (i, j) may reach the similarity num/den, by size and bitmap."""
    ni, nj = x["n"][i], y["n"][j]
    small, large = np.minimum(ni, nj), np.maximum(ni, nj)
    apart = np.bitwise_count(x["b0"][i] ^ y["b0"][j]).astype(np.int64)
    apart += np.bitwise_count(x["b1"][i] ^ y["b1"][j])
    return (small * den >= large * num) & (apart * (den + num) <= (ni + nj) * (den - num)) & (x["id"][i] != y["id"][j])


def _joined(x: dict, y: dict, same: bool, num: int, den: int, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs between two blocks, in steps of bounded size."""
    nx, ny = len(x["id"]), len(y["id"])
    rows = max(1, step // max(ny, 1))
    for a in range(0, nx, rows):
        b = min(nx, a + rows)
        i = np.repeat(np.arange(a, b), ny)
        j = np.tile(np.arange(ny), b - a)
        if same:
            i, j = i[i < j], j[i < j]
        ok = _close(x, i, y, j, num, den)
        yield x["id"][i[ok]], y["id"][j[ok]]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays(
        [pa.array(low), pa.array(high)] + [pa.nulls(len(low), pa.int64())] * 5, ["a", "b", "key", "block", "n", "b0", "b1"]
    )


def _region_joiner(num: int, den: int, block: int):
    """Join the regions of a partition sorted by key; blocks of a region beyond ``block`` rows are handed on.

    Rows with a null ``a`` are such blocks' members, with ``b`` as their id.
    """
    names = ("key", "id", "n", "b0", "b1")

    def columns(batch: pa.RecordBatch) -> dict:
        got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        return got | {c: got[c].view(np.uint64) for c in ("b0", "b1")} | {"n": got["n"].astype(np.int64)}

    def within(x: dict) -> Iterator[pa.RecordBatch]:
        """All regions of whole rows: pairs at distance 1, 2, ... in the sorted order."""
        key, left = x["key"], np.arange(len(x["key"]))
        far = 1
        while True:
            left = left[left + far < len(key)]
            left = left[key[left] == key[left + far]]
            if not len(left):
                return
            ok = _close(x, left, x, left + far, num, den)
            if ok.any():
                yield _pair_batch(x["id"][left[ok]], x["id"][left[ok] + far])
            far += 1

    def handed(x: dict, number: int) -> pa.RecordBatch:
        n = len(x["id"])
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()), pa.array(x["id"]), pa.array(x["key"]), pa.array(np.full(n, number, np.int64)),
                pa.array(x["n"]), pa.array(x["b0"].view(np.int64)), pa.array(x["b1"].view(np.int64)),
            ],
            ["a", "b", "key", "block", "n", "b0", "b1"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the region that may go on in the next batch
        number = 0  # blocks of that region already handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = columns(batch)
            if held is not None:
                if number and x["key"][0] != held["key"][0]:
                    yield handed(held, number)
                    held, number = None, 0
                else:
                    x = {c: np.concatenate([held[c], x[c]]) for c in names}
            other = np.flatnonzero(x["key"] != x["key"][-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last and number:  # the handed region ends inside this batch
                end = int(np.flatnonzero(x["key"] != x["key"][0])[0])
                yield handed({c: x[c][:end] for c in names}, number)
                x, last, number = {c: x[c][end:] for c in names}, last - end, 0
            yield from within({c: x[c][:last] for c in names})
            held = {c: x[c][last:] for c in names}
            while len(held["id"]) > block:
                yield handed({c: held[c][:block] for c in names}, number)
                held, number = {c: held[c][block:] for c in names}, number + 1
        if held is not None:
            if number:
                yield handed(held, number)
            else:
                yield from within(held)

    return run


def _block_joiner(num: int, den: int):
    """Join two blocks of one region, or one with itself; the left block's rows come first."""

    def run(key, batch):  # no annotations: Spark reads them
        side = batch.column("side").to_numpy()
        cols = {c: batch.column(c).to_numpy() for c in ("b", "n", "b0", "b1")}
        x, y = (
            {"id": cols["b"][side == s], "n": cols["n"][side == s].astype(np.int64)}
            | {c: cols[c][side == s].view(np.uint64) for c in ("b0", "b1")}
            for s in (0, 1)
        )
        same = key[1].as_py() == key[2].as_py()
        got = list(_joined(x, x if same else y, same, num, den)) or [(np.empty(0, np.int64),) * 2]
        a, b = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def classes(df: DataFrame, id_col: str, text_cols: Sequence[str], *, min_words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, class_id, n, b0, b1, keys): each record, its class of equal word sets, its sketches; staged."""
    sets = word_sets(df, id_col, text_cols, min_words)
    hashed = sets.select(
        F.col("id").cast("long").alias("id"),
        F.sha2(F.concat_ws(" ", F.array_sort("words")), 256).substr(1, 32).alias("set_key"),
        "n",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    schema = "id long, set_key string, n int, b0 long, b1 long, keys array<long>"
    sketched = stage(hashed.mapInArrow(_sketcher(bands, rows, seed), schema), "sketches")
    first = sketched.groupBy("set_key").agg(F.min("id").alias("class_id"))
    return sketched.join(first, "set_key").drop("set_key")


def class_links(
    df: DataFrame,
    id_col: str,
    text_cols: Sequence[str],
    *,
    similarity: tuple[int, int] = (8, 10),
    min_words: int = 1,
    bands: int = 30,
    rows: int = 4,
    block: int = 16384,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and links (a, b) between the ids of different classes.

    A class is all records with one word set, named by its smallest id; a < b.
    Two sets of Jaccard similarity s meet in some region with a probability of
    1 - (1 - s**rows)**bands; each link is then checked exactly on the words.
    """
    num, den = similarity
    records = classes(df, id_col, text_cols, min_words=min_words, bands=bands, rows=rows, seed=seed)
    members = stage(records.select("id", "class_id", "n", *(["b0", "b1", "keys"])), "classes")
    heads = members.filter("id = class_id")
    entries = heads.select(F.explode("keys").alias("key"), "id", "n", "b0", "b1")
    entries = entries.repartition("key").sortWithinPartitions("key")
    schema = "a long, b long, key long, block long, n long, b0 long, b1 long"
    met = entries.mapInArrow(_region_joiner(num, den, block), schema)
    met = stage(met, "regions")
    inside = met.filter("a is not null").select("a", "b")
    large = met.filter("a is null")
    if large.limit(1).count():
        top = large.groupBy("key").agg(F.max("block").alias("top"))
        both = large.join(top, "key")
        left = both.select("*", F.explode(F.sequence("block", "top")).alias("other")).select(
            "key", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "b", "n", "b0", "b1"
        )
        right = both.filter("block > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("other")).select(
            "key", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "b", "n", "b0", "b1"
        )
        between = left.union(right).groupBy("key", "i", "j").applyInArrow(_block_joiner(num, den), "a long, b long")
        inside = inside.union(between)
    found = stage(inside.distinct(), "candidates")
    return members.select("id", "class_id"), stage(_verified(df, id_col, text_cols, found, min_words, num, den), "links")


def _verified(df: DataFrame, id_col: str, text_cols: Sequence[str], pairs: DataFrame, min_words: int, num: int, den: int) -> DataFrame:
    """Candidates whose words do reach the similarity; only their own words are shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = df.join(ends.withColumnRenamed("id", id_col), id_col, "left_semi")
    sets = word_sets(texts, id_col, text_cols, min_words).withColumn("id", F.col("id").cast("long"))
    sets = stage(sets, "words")
    one = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na"))
    two = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    both = both.select("a", "b", "na", "nb", common.alias("o"))
    return both.filter(F.col("o") * den >= (F.col("na") + F.col("nb") - F.col("o")) * num).select("a", "b")


def pairs(df: DataFrame, id_col: str, text_cols: Sequence[str], **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two records whose word sets reach the similarity.

    Copies are expanded, so a group of m equal records gives m(m-1)/2 rows:
    where groups are large use :func:`groups`. Null text columns are left out of
    the text; records with fewer than ``min_words`` words, and so empty ones, are in
    no pair. An empty table gives no rows. Ids are taken to be unique.
    """
    members, links = class_links(df, id_col, text_cols, **options)
    a = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    copies = a.join(b.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    both = across.unionByName(copies)
    return both.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def groups(df: DataFrame, id_col: str, text_cols: Sequence[str], **options) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per record that has enough words.

    ``class_id`` names the records with the same word set, ``group_id`` the
    connected classes (smallest id in either), ``n_links`` counts the records it
    reaches the similarity with, copies included.
    """
    members, links = class_links(df, id_col, text_cols, **options)
    size = stage(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = ways.join(size.select(F.col("class_id").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("reach"))
    heads = size.join(around.withColumnRenamed("a", "class_id"), "class_id", "left")
    heads = heads.select("class_id", (F.col("size") - 1 + F.coalesce("reach", F.lit(0))).alias("n_links"))
    label = connected(links)
    heads = heads.join(label.withColumnRenamed("id", "class_id"), "class_id", "left")
    heads = heads.select("class_id", F.coalesce("label", "class_id").alias("group_id"), "n_links")
    return members.join(heads, "class_id").select(F.col("id").alias(id_col), "class_id", "group_id", "n_links")


def connected(links: DataFrame) -> DataFrame:
    """(id, label): connected components of (a, b), each named by its smallest id.

    Alternates large-star and small-star steps; every round is staged, and the
    driver only learns whether anything changed.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").filter("x <> m").union(least.select("u", "m"))
        small = stage(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "small")
        if not edges.exceptAll(small).limit(1).count() and not small.exceptAll(edges).limit(1).count():
            break
        edges = small
    roots = small.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return small.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
