"""The k most similar vectors of every vector: inverted lists and adaptive dimension scan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import vectors as V
from quillon.runtime import stage


#: Most ids that are broadcast.
BROADCAST_IDS = 500_000


#: Queries of one cell that are searched by one task; a cell that more of them visit is held in as many copies as they need.
VISITS = 16_384


def _visited(index: V.Index, g: str, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells of the probed lists of each row, each once."""
    cells = int((index.cells + index.blocks).max(initial=1))
    lists = index.nearest(g, x, probes)
    at, lists = np.repeat(np.arange(len(lists)), lists.shape[1]), lists.reshape(-1)
    many = index.blocks[lists]
    block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.divmod(np.unique(np.repeat(at, many) * cells + np.repeat(index.cells[lists], many) + block), cells)


def _copies(index: V.Index, queries: DataFrame, probes: int | Mapping[str, int]) -> tuple[np.ndarray, int]:
    """How many copies of each cell its visits need, and the number of visits. The driver sees a count per cell."""
    cells = int((index.cells + index.blocks).max(initial=1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for g, _, x in V.by_group(batches):
            for a in range(0, len(x), 2048):
                n += np.bincount(_visited(index, g, x[a : a + 2048], V.of(probes, g))[1], minlength=cells)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["cell", "n"])

    visits = np.zeros(cells, np.int64)
    for r in queries.select("id", "grp", "vec").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visits[r["cell"]] = r["n"]
    return np.maximum(1, -(-visits // VISITS)), int(visits.sum())


def _placer(index: V.Index, probes: int | Mapping[str, int], role: int, salt: int, copies: np.ndarray, part: int = 1 << 16):
    """(cell, role, id, vec, least) of each row: role 0 in its closest list, in every copy of the cell; role 1 once in every cell of its probed lists, in one copy."""
    first = np.cumsum(copies) - copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, mine in V.of_group(batch):
                ids, x, least = mine.column("id").to_numpy(), V.as_matrix(mine.column("vec")), mine.column("least")
                half = x.astype(np.float16)
                for a in range(0, len(ids), 2048):
                    if role:
                        at, cell = _visited(index, g, x[a : a + 2048], V.of(probes, g))
                        at = at + a
                        to = first[cell] + (V.mixed(ids[at], salt + 1) % copies[cell].astype(np.uint64)).astype(np.int64)
                    else:
                        lists = index.nearest(g, x[a : a + 2048], 1)[:, 0]
                        at = np.arange(a, a + len(lists))
                        cell = index.cells[lists] + (V.mixed(ids[at], salt) % index.blocks[lists].astype(np.uint64)).astype(np.int64)
                        many = copies[cell]
                        at, to = np.repeat(at, many), np.repeat(first[cell], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    for b in range(0, len(at), part):
                        i, cells = at[b : b + part], to[b : b + part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cells), pa.array(np.full(len(i), role, np.int32)), pa.array(ids[i]), V.as_binary(half[i]), least.take(pa.array(i))],
                            ["cell", "role", "id", "vec", "least"],
                        )

    return run


def _scanner(k: int, min_cosine: float | None, eps: float, chunk: int = 512):
    """Best k of a cell's rows for each query that probes it; ``least`` is the k-th cosine it has seen elsewhere, null if unknown."""

    def step(ids: np.ndarray, column: pa.Array, kept: list, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        base_ids = np.concatenate([i for i, _ in kept])
        base = np.concatenate([x if isinstance(x, np.ndarray) else V.as_matrix(x) for _, x in kept])
        kept[:] = [(base_ids, base)]
        queries = V.as_matrix(column)
        for a in range(0, len(ids), chunk):
            q = queries[a : a + chunk]
            own = ids[a : a + chunk]
            if min_cosine is not None:
                bound = np.full(len(q), 2 - 2 * min_cosine, np.float32)
            else:
                bound = np.nan_to_num(2 - 2 * least[a : a + chunk].astype(np.float32) + np.float32(1e-3), nan=4.1)
            if min_cosine is None and len(base) > 8 * (k + 1):
                head = q @ base[: 8 * (k + 1)].T
                bound = np.minimum(bound, 2 - 2 * -np.partition(-head, k, axis=1)[:, k] + 1e-3)
            i, j, cosine = V.adaptive_scan(q, base, bound, eps)
            other = own[i] != base_ids[j]
            i, j, cosine = i[other], j[other], cosine[other]
            best = V.first_k(i, cosine, base_ids[j], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[i[best]]), pa.array(base_ids[j[best]]), pa.array(cosine[best].astype(np.float32))], ["a", "b", "cosine"]
            )

    return lambda batches: V.cells_of(batches, step)


def search(
    base: DataFrame,
    queries: DataFrame,
    index: V.Index,
    *,
    k: int,
    probes: int | Mapping[str, int],
    min_cosine: float | None = None,
    eps: float = 2.1,
    salt: int = 0,
    bounded: int = 0,
) -> DataFrame:
    """(a, b, cosine): of each query a the k rows b of highest cosine in its ``probes`` closest lists.

    Both inputs are (id, grp, vec) as :func:`vectors.prepared` gives them. Ties go to the smaller id; a row is not its own
    neighbour. With ``bounded``, so many of the closest lists are searched first, and their k-th cosine is the bound beyond which candidates
    are abandoned in all others.
    """
    schema = "cell long, role int, id long, vec binary, least float"
    own = base.select("id", "grp", "vec", F.lit(None).cast("float").alias("least"))
    asked = queries.select("id", "grp", "vec", F.lit(None).cast("float").alias("least"))
    if bounded:
        seen = search(base, queries, index, k=k, probes=bounded, min_cosine=min_cosine, eps=eps, salt=salt).groupBy(F.col("a").alias("id"))
        least = seen.agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("least"))
        asked = asked.drop("least").join(least, "id", "left").select("id", "grp", "vec", "least")
    copies, visits = _copies(index, queries, probes)
    held = own.mapInArrow(_placer(index, 1, 0, salt, copies), schema)
    sent = visits + float(index.held.sum()) * float(copies.mean() if len(copies) else 1)
    rows = V.by_cell(held.union(asked.mapInArrow(_placer(index, probes, 1, salt, copies), schema)), sent, "role")
    near = rows.mapInArrow(_scanner(k, min_cosine, eps), "a long, b long, cosine float")
    return _best(near, k)


def measured(
    base: DataFrame, queries: DataFrame, index: V.Index, *, k: int, recall: float, least: int = 4, min_cosine: float | None = None, asked: int = 256, seed: int = 23
) -> dict[str, int]:
    """How many of the closest lists each group's queries must probe for a recall of ``recall``.

    ``asked`` queries a group, those of the lowest hashes, are compared with all rows; counted is how many lists are
    closer to the query than the one that holds each of its k neighbours. At least ``least`` lists; with ``min_cosine`` only
    neighbours that similar count. The driver sees these queries and a list number per neighbour.
    """
    lowest = Window.partitionBy("grp").orderBy("h", "id")
    some = queries.select("id", "grp", "vec", F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= asked)
    sample = some.select("id", "grp", "vec").toArrow().combine_chunks()
    asking = {g: (t.column("id").to_numpy(), V.as_matrix(t.column("vec"))) for b in sample.to_batches() for g, t in V.of_group(b)}
    names = sorted(asking)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for g, ids, x in V.by_group(batches):
            if g not in asking:
                continue
            own, q = asking[g]
            for a in range(0, len(ids), 4096):
                score = q @ x[a : a + 4096].T
                score[own[:, None] == ids[None, a : a + 4096]] = -9
                lists = np.broadcast_to(index.nearest(g, x[a : a + 4096], 1)[:, 0], score.shape)
                if g in best:
                    score, lists = np.concatenate([best[g][0], score], 1), np.concatenate([best[g][1], lists], 1)
                top = V._top(score, min(k, score.shape[1]))
                best[g] = np.take_along_axis(score, top, 1), np.take_along_axis(lists, top, 1)
        for g, (score, lists) in best.items():
            i, j = np.nonzero(score >= (-2 if min_cosine is None else min_cosine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), names.index(g))), pa.array(i), pa.array(lists[i, j]), pa.array(score[i, j])], ["g", "q", "list", "cosine"]
            )

    near = base.select("id", "grp", "vec").mapInArrow(exact, "g long, q long, list long, cosine float")
    order = Window.partitionBy("g", "q").orderBy(F.col("cosine").desc(), "list")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("g", "q", "list").toArrow()
    out = dict.fromkeys(index.centroids, least)
    for n, g in enumerate(names):
        mine = near.filter(pa.compute.equal(near.column("g"), n))
        q, lists = mine.column("q").to_numpy(), mine.column("list").to_numpy() - index.first[g]
        score = asking[g][1] @ index.centroids[g].T
        rank = np.sort((score[q] > score[q, lists][:, None]).sum(1))
        if len(rank):
            out[g] = max(least, int(rank[math.ceil(recall * len(rank)) - 1]) + 1)
    return out


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def nearest(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vector_col: str,
    lengths: Mapping[str, int],
    *,
    k: int = 8,
    probes: int | None = None,
    recall: float = 0.98,
    min_cosine: float | None = None,
    query_filter: str | None = None,
    sample: int = 65536,
    block: int = 4096,
    eps: float = 2.1,
) -> DataFrame:
    """(id, neighbour, rank, cosine): the k most similar rows of the same group for every usable row.

    ``query_filter`` (SQL over ``id``) restricts the rows that ask, never those
    that answer; ``min_cosine`` drops neighbours below it and lets the scan
    abandon candidates at once. Each query visits its ``probes`` closest lists; by default as many as :func:`measured` finds
    to be needed for ``recall``, so that the recall does not depend on the number of rows. Every usable row is indexed; ``sample`` bounds only
    what the list centroids are fitted on. A list of more than ``block`` rows is
    split, and each query visits all its blocks. Rows with equal vectors are searched
    for as one and are each other's neighbours at a cosine of 1, the smallest ids first. Unusable rows neither ask nor
    answer; an empty table, or a group of one row, gives no rows.
    """
    rows = V.prepared(df, id_col, group_col, vector_col, lengths)
    twins = _twins(rows, k)
    others = twins.filter("id <> head").select("id")
    # beyond this many copies (8 bytes each) the vectors are shuffled instead
    others = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
    heads = rows.join(others, "id", "left_anti")
    index = V.fit_index(heads, sample=sample, block=block, grouped=min_cosine is None)
    asked = twins.filter(query_filter) if query_filter else twins
    asking = stage(heads.join(asked.select(F.col("head").alias("id")).distinct(), "id", "left_semi"), "asking") if query_filter else heads
    wanted = measured(heads, asking, index, k=k, recall=recall, min_cosine=min_cosine) if probes is None else probes
    found = search(heads, asking, index, k=k, probes=wanted, min_cosine=min_cosine, eps=eps, bounded=8 if min_cosine is None and probes is None else 0)
    shown = twins.filter(F.col("place") <= k + 1).select("head", F.col("id").alias("b"))
    many = shown.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head")
    across = found.select("a", F.col("b").alias("head"), "cosine").join(shown, "head").select("a", "b", "cosine")
    own = shown.join(many, "head").select(F.col("head").alias("a"), "b", F.lit(1.0).cast("float").alias("cosine"))
    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    best = across.unionByName(own).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    each = best.join(asked.select("id", F.col("head").alias("a")), "a").filter("id <> b")
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "b")
    return each.select("id", F.col("b").alias("neighbour"), F.row_number().over(order).alias("rank"), "cosine").filter(F.col("rank") <= k)


def _twins(rows: DataFrame, k: int) -> DataFrame:
    """(id, head, place): of each row the smallest id with an equal vector, and its place among those ids up to k + 1; staged.

    Copies are searched for once, by their head, so that a group of copies of any size costs no
    more than its rows. Places are found within salted parts of a group first.
    """
    key = ["grp", "h", "g"]
    copies = rows.select("id", "grp", F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    part = Window.partitionBy(*key, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = copies.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k + 1).drop("r")
    few = few.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).filter(F.col("place") <= k + 1)
    head = few.filter("place = 1").select(*key, F.col("id").alias("head"))
    place = few.select("id", "place")
    return stage(copies.join(head, key).join(place, "id", "left").select("id", "head", F.coalesce("place", F.lit(k + 2)).alias("place")), "twins")


def similar_pairs(df: DataFrame, id_col: str, group_col: str, vector_col: str, lengths: Mapping[str, int], *, min_cosine: float, **options) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: neighbours of each other at ``min_cosine`` or more."""
    near = nearest(df, id_col, group_col, vector_col, lengths, min_cosine=min_cosine, **options)
    low, high = F.least("id", "neighbour"), F.greatest("id", "neighbour")
    both = near.groupBy(low.alias(f"{id_col}_a"), high.alias(f"{id_col}_b"))
    return both.agg(F.max("cosine").alias("cosine"))
