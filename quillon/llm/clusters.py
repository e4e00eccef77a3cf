"""Clusters of mutually similar vectors by parallel pivot correlation clustering.

Rows are ordered by a hash of their ids. In the first round each list of a coarse index
settles by itself: a row with no similar row of lower hash is a local minimum and
becomes a pivot, pivots absorb the rows similar to them, and so on. Pivots stay open.
In each later round the open rows meet in lists of an index fitted on them alone, as many
lists a row as a measured sample asks for and every block of a list with every other; whose lowest similar row is a pivot is absorbed by it. Rounds end when
nothing is absorbed. Members then go to the closest pivot, and medoids are taken anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import vectors as V
from quillon.llm.neighbours import BROADCAST_IDS, measured, search
from quillon.runtime import stage


def _cells(index: V.Index, probes: int | Mapping[str, int], salt: int, paired: bool = False):
    """(cell, grp, id, vec): each row once in each of its closest lists, in one block of it.

    ``paired``, a cell is two blocks of a list, and each row is in all cells of its block, so that every row of a list meets every other.
    """
    pairs = np.maximum(1, index.blocks * (index.blocks - 1) // 2)
    first_pair = np.cumsum(pairs) - pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, ids, x in V.by_group(batches):
            for a in range(0, len(ids), 2048):
                part, own = x[a : a + 2048], ids[a : a + 2048]
                lists = index.nearest(g, part, V.of(probes, g))
                at = np.repeat(np.arange(len(own)), lists.shape[1])
                lists = lists.reshape(-1)
                block = (V.mixed(own[at], salt) % index.blocks[lists].astype(np.uint64)).astype(np.int64)
                if paired:
                    many = np.maximum(1, index.blocks[lists] - 1)
                    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    at, lists, block = np.repeat(at, many), np.repeat(lists, many), np.repeat(block, many)
                    other += other >= block  # a list of one block has the cell of blocks 0 and 1
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    cell = first_pair[lists] + high * (high - 1) // 2 + low
                else:
                    cell = index.cells[lists] + block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array([g] * len(at), pa.string()), pa.array(own[at]), V.as_binary(part[at].astype(np.float16))],
                    ["cell", "grp", "id", "vec"],
                )

    return run


def _lowest(threshold: float, salt: int, chunk: int = 512):
    """(id, lowest, rank) of the rows of each cell: the similar row of lowest hash, only where that is another row."""

    def solve(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        rank = V.mixed(ids, salt)
        order = np.lexsort((ids, rank))
        ids, x, rank = ids[order], x[order], rank[order]
        low = np.arange(len(ids))
        for a in range(0, len(ids), chunk):
            z = min(len(ids), a + chunk)
            near = x[a:z] @ x[:z].T >= threshold
            low[a:z] = np.minimum(near.argmax(1), np.arange(a, z))  # in order of rank, so the first is the lowest
            none = ~near.any(1)
            low[a:z][none] = np.arange(a, z)[none]
        some = np.flatnonzero(low != np.arange(len(ids)))
        # a signed rank in the same order
        signed = (rank[low[some]] ^ np.uint64(1 << 63)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]]), pa.array(signed)], ["id", "low", "rank"])

    return lambda batches: (solve(ids, x) for _, ids, x in _whole_cells(batches))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, ids, matrix) of each cell of a partition sorted by cell; a cell holds two blocks at most."""
    cell, held, grp = None, [], ""
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for a, z in V._runs(cells):
            if cells[a] != cell:
                if held:
                    yield grp, np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
                cell, held, grp = cells[a], [], batch.column("grp")[a].as_py()
            ids = batch.column("id").slice(a, z - a).to_numpy()
            held.append((ids, V.as_matrix(batch.column("vec").slice(a, z - a))))
    if held:
        yield grp, np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])


def _settled(threshold: float, salt: int, chunk: int = 256):
    """(id, grp, pivot, vec) of the rows of each cell, settled among themselves: vec only of pivots, whose pivot is null."""

    def solve(grp: str, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, V.mixed(ids, salt)))
        ids, x = ids[order], x[order]
        pivot = np.full(len(ids), -1)
        heads = np.empty(0, np.int64)
        for a in range(0, len(ids), chunk):
            part = x[a : a + chunk]
            if len(heads):
                near = part @ x[heads].T >= threshold
                hit = near.any(1)
                pivot[a : a + len(part)][hit] = heads[near.argmax(1)[hit]]
            left = a + np.flatnonzero(pivot[a : a + len(part)] < 0)
            near = x[left] @ x[left].T >= threshold
            new = []
            for k in range(len(left)):
                if pivot[left[k]] < 0:
                    new.append(left[k])
                    take = left[k + 1 :][near[k, k + 1 :]]
                    pivot[take[pivot[take] < 0]] = left[k]
            heads = np.concatenate([heads, np.array(new, np.int64)])
        away = np.flatnonzero(pivot >= 0)
        rows = pa.array(np.concatenate([ids[heads], ids[away]]))
        none = pa.nulls(len(away), pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                rows, pa.array([grp] * len(rows), pa.string()),
                pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array(ids[pivot[away]])]),
                pa.concat_arrays([V.as_binary(x[heads].astype(np.float16)), none]),
            ],
            ["id", "grp", "pivot", "vec"],
        )

    return lambda batches: (solve(*cell) for cell in _whole_cells(batches))


def assign(rows: DataFrame, *, threshold: float, probes: int, sample: int, block: int, seed: int = 5) -> DataFrame:
    """(id, pivot) of every row of (id, grp, vec) that another row's pivot absorbed; staged."""
    cells = "cell long, grp string, id long, vec binary"
    index = V.fit_index(rows, sample=sample, block=block, seed=seed)
    placed = V.by_cell(rows.mapInArrow(_cells(index, 1, seed), cells), float(index.held.sum()))
    first = stage(placed.mapInArrow(_settled(threshold, seed), "id long, grp string, pivot long, vec binary"), "settled")
    rounds = [first.filter("pivot is not null").select("id", "pivot")]
    open_rows = first.filter("pivot is null").select("id", "grp", "vec")
    wanted = None
    while True:
        salt = seed + len(rounds)
        if wanted is None:  # as many lists as it takes for similar open rows to meet, the same in all rounds
            index = V.fit_index(open_rows, sample=sample, block=block, seed=salt)
            wanted = measured(open_rows, open_rows, index, k=8, recall=0.95, least=probes, min_cosine=threshold, asked=2048)
        index = V.fit_index(open_rows, sample=sample, block=block, probes=wanted, seed=salt)
        copies = float((index.held * np.maximum(1, index.blocks - 1)).sum())
        placed = V.by_cell(open_rows.mapInArrow(_cells(index, wanted, salt, paired=True), cells), copies)
        seen = placed.mapInArrow(_lowest(threshold, seed), "id long, low long, rank long")
        lower = stage(seen.groupBy("id").agg(F.min(F.struct("rank", "low")).alias("m")).select("id", F.col("m.low").alias("low")), "lowest")
        # absorbed: the lowest has no lower one itself
        absorbed = lower.join(lower.select(F.col("id").alias("low")), "low", "left_anti").select("id", F.col("low").alias("pivot"))
        absorbed = stage(absorbed, "absorbed")
        if not absorbed.limit(1).count():
            break
        rounds.append(absorbed)
        open_rows = stage(open_rows.join(absorbed, "id", "left_anti"), "open")
    final = None
    for absorbed in reversed(rounds):  # a pivot may have been absorbed in a later round
        if final is None:
            final = absorbed
        else:
            later = final.select(F.col("id").alias("pivot"), F.col("pivot").alias("last"))
            moved = absorbed.join(later, "pivot", "left").select("id", F.coalesce("last", "pivot").alias("pivot"))
            final = stage(moved.unionByName(final), "pivots")
    return final if final is not None else rows.select("id", F.col("id").alias("pivot")).filter("false")


def clusters(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vector_col: str,
    lengths: Mapping[str, int],
    *,
    threshold: float = 0.8,
    min_size: int = 3,
    probes: int = 4,
    sample: int = 65536,
    block: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, grp, vec) and members (id, grp, pivot, size) of the clusters of at least ``min_size`` rows.

    Unusable rows and rows similar to no pivot are in no cluster; every other row but the pivots goes to the
    closest pivot, absorbed in a round or not. Rows with equal
    vectors are rows of their own. An empty table gives no rows. Ids are taken to
    be unique across the groups.
    """
    rows = V.prepared(df, id_col, group_col, vector_col, lengths)
    joined = assign(rows, threshold=threshold, probes=probes, sample=sample, block=block)
    heads = stage(joined.select(F.col("pivot").alias("id")).distinct(), "pivot_ids")
    # beyond this many pivots (8 bytes each) the vectors are shuffled instead
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_IDS else heads
    pivots = stage(rows.join(heads, "id", "left_semi"), "heads")
    # few pivots for many rows: lists close to each other share a cell, so that a row is sent to few
    index = V.fit_index(pivots, sample=sample, block=min(block, 1024), grouped=True)
    asking = rows.join(heads, "id", "left_anti")
    wanted = measured(pivots, asking, index, k=1, recall=0.995, least=2, min_cosine=threshold, asked=2048)
    close = search(pivots, asking, index, k=1, probes=wanted, min_cosine=threshold)
    close = close.select(F.col("a").alias("id"), F.col("b").alias("near"))
    moved = joined.join(heads, "id", "left_anti").join(close, "id", "full")
    # a pivot stays with its own cluster; a member of which the scan lost every pivot stays where it was
    labels = moved.select("id", F.coalesce("near", "pivot").alias("pivot")).unionByName(pivots.select("id", F.col("id").alias("pivot")))
    labels = stage(labels, "labels")
    size = labels.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster_id")).filter(F.col("size") >= min_size)
    return rows, labels.join(size, "pivot")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each cluster of a batch: the part before the shuffle."""
    for batch in batches:
        label = batch.column("cluster_id").to_numpy()
        size = np.diff(np.frombuffer(batch.column("vec").buffers()[1], np.int32, len(label) + 1, batch.column("vec").offset * 4))
        for width in np.unique(size):
            mine = np.flatnonzero(size == width)
            mine = mine[np.argsort(label[mine], kind="stable")]
            x = V.as_matrix(batch.column("vec").take(pa.array(mine)))
            name, start = np.unique(label[mine], return_index=True)
            total = np.add.reduceat(x, start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(name), V.as_binary(total.astype(np.float32))], ["cluster_id", "vec"])


def _typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of each member with its cluster's mean."""
    for batch in batches:
        ids, label = batch.column("id"), batch.column("cluster_id")
        size = np.diff(np.frombuffer(batch.column("vec").buffers()[1], np.int32, len(ids) + 1, batch.column("vec").offset * 4))
        for width in np.unique(size):
            mine = pa.array(np.flatnonzero(size == width))
            x, m = V.as_matrix(batch.column("vec").take(mine)), V.as_matrix(batch.column("mean").take(mine), np.float32)
            cosine = np.einsum("ij,ij->i", x, m) / np.maximum(np.linalg.norm(m, axis=1), 1e-9)
            yield pa.RecordBatch.from_arrays([ids.take(mine), label.take(mine), pa.array(cosine.astype(np.float64))], ["id", "cluster_id", "cosine"])


def described(rows: DataFrame, members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, grp, size, medoids): each cluster with the ids of its ``typical`` members closest to its mean."""
    inside = stage(members.select("id", "cluster_id", "size").join(rows, "id"), "members")
    partial = inside.select("cluster_id", "vec").mapInArrow(_sums, "cluster_id long, vec binary")
    mean = _folded(_folded(partial, salted=True), salted=False)
    both = inside.join(mean.withColumnRenamed("vec", "mean"), "cluster_id").select("id", "cluster_id", "vec", "mean")
    scored = both.mapInArrow(_typical, "id long, cluster_id long, cosine double")
    order = Window.partitionBy("cluster_id").orderBy(F.round("cosine", 5).desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical)
    best = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("medoids"))
    size = inside.groupBy("cluster_id", "grp").agg(F.count(F.lit(1)).alias("size"))
    return size.join(best, "cluster_id")


def _folded(sums: DataFrame, salted: bool) -> DataFrame:
    """Add up the partial sums of each cluster, first in salted groups, then over all."""

    def add(key, table):  # no annotations: Spark reads them
        total = V.as_matrix(table.column("vec").combine_chunks(), np.float32).sum(0, keepdims=True)
        return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int64()), "vec": V.as_binary(total)})

    salt = (F.spark_partition_id() % 16 if salted else F.lit(0)).alias("salt")
    return sums.select("cluster_id", salt, "vec").groupBy("cluster_id", "salt").applyInArrow(add, "cluster_id long, vec binary")
