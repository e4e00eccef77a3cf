"""Vectors as rotated unit rows, the coarse index over them, and the adaptive dimension scan.

Rotated by one seeded random orthogonal matrix per length, the first columns of a
vector are a fair sample of all of them. A candidate is abandoned as soon as
its distance over the columns seen so far is, by a hypothesis test, too large
for the distance over all columns to stay within the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import stage


def usable(df: DataFrame, id_col: str, group_col: str, vector_col: str, lengths: Mapping[str, int]) -> DataFrame:
    """(id, grp, feature) of the rows with a full, finite, non-zero vector.

    A null id, group, vector or element, another length than the group's, a group
    that ``lengths`` does not name, NaN, infinity, and all zeros make a row unusable.
    """
    v, g = F.col(f"`{vector_col}`"), F.col(f"`{group_col}`")
    length = F.lit(None).cast("int")
    for name, n in lengths.items():
        length = F.when(g == name, F.lit(n)).otherwise(length)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull() & (F.size(v) == length) & ~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), g.alias("grp"), v.cast("array<float>").alias("feature"))


def rotation(length: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, length)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of equal values."""
    if len(values):
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def as_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def as_matrix(column: pa.Array, dtype=np.float16) -> np.ndarray:
    """Binary values of one width as a float32 matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), -1).astype(np.float32, copy=False)


def prepared(df: DataFrame, id_col: str, group_col: str, vector_col: str, lengths: Mapping[str, int], seed: int = 11) -> DataFrame:
    """(id, grp, vec) of the usable rows, vec holding the rotated unit vector; staged.

    Vectors are kept in half precision, which halves all that is shuffled and moves a
    cosine by less than 0.001.
    """
    turns = {n: rotation(n, seed + n) for n in set(lengths.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("grp").to_numpy(zero_copy_only=False)
            column = batch.column("feature")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                x = flat[(at[mine][:, None] + np.arange(n)).reshape(-1)].reshape(len(mine), n).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = (x.astype(np.float32) @ turns[int(n)]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(mine)), pa.array(group[mine], pa.string()), as_binary(x)], ["id", "grp", "vec"]
                )

    rows = usable(df, id_col, group_col, vector_col, lengths)
    return stage(rows.mapInArrow(run, "id long, grp string, vec binary"), "vectors")


#: Up to so many lists, each is compared with each row; beyond, only those below the closest upper centroids.
FLAT = 2048


@dataclass(frozen=True)
class Index:
    """Centroids of each group, in one level or two, and how many rows and blocks each list has.

    In two levels the lists of an upper centroid stand next to each other, ``starts`` holding the first of each and the end.
    """

    centroids: dict[str, np.ndarray]
    first: dict[str, int]
    uppers: dict[str, np.ndarray]
    starts: dict[str, np.ndarray]
    held: np.ndarray
    blocks: np.ndarray
    cells: np.ndarray

    def nearest(self, group: str, x: np.ndarray, probes: int, beam: int = 8) -> np.ndarray:
        """The numbers of the closest lists of each row, closest first."""
        c = self.centroids[group]
        m = min(probes, len(c))
        if len(c) <= FLAT or 4 * m >= len(c):
            return _top(x @ c.T, m) + self.first[group]
        u, starts = self.uppers[group], self.starts[group]
        beam = min(len(u), max(beam, -(-4 * m * len(u) // len(c))))
        parents = _top(x @ u.T, beam)
        width = int(np.diff(starts).max())
        score = np.full((len(x), beam, width), -9, np.float32)
        row, place = np.divmod(np.argsort(parents, axis=None, kind="stable"), beam)
        for a, z in _runs(parents[row, place]):
            low, high = starts[parents[row[a], place[a]]], starts[parents[row[a], place[a]] + 1]
            score[row[a:z], place[a:z], : high - low] = x[row[a:z]] @ c[low:high].T
        best = _top(score.reshape(len(x), -1), m)
        return starts[np.take_along_axis(parents, best // width, 1)] + best % width + self.first[group]


def of(probes: int | Mapping[str, int], group: str) -> int:
    """How many lists a group probes."""
    return probes if isinstance(probes, int) else probes[group]


def _top(score: np.ndarray, m: int) -> np.ndarray:
    """The columns of the m largest scores of each row, largest first."""
    if m == 1:
        return score.argmax(1)[:, None]
    top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.tile(np.arange(m), (len(score), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        present, start = np.unique(near[order], return_index=True)
        c[present] = np.add.reduceat(x[order], start, axis=0)
        empty = np.setdiff1d(np.arange(k), present)
        c[empty] = x[rng.choice(len(x), len(empty))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each id."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _levels(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, upper centroids, starts): k lists, in two levels if there are more than :data:`FLAT`."""
    if k <= FLAT:
        return _kmeans(x, k, seed), np.zeros((1, x.shape[1]), np.float32), np.array([0, k])
    upper = _kmeans(x, math.ceil(math.sqrt(k)), seed)
    near = np.concatenate([(x[i : i + 8192] @ upper.T).argmax(1) for i in range(0, len(x), 8192)])
    parts = []
    for u in range(len(upper)):
        own = x[near == u]
        parts.append(_kmeans(own, max(1, min(len(own), round(k * len(own) / len(x)))), seed) if len(own) else upper[u : u + 1])
    return np.concatenate(parts), upper, np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def fit_index(rows: DataFrame, *, sample: int, block: int, probes: int | Mapping[str, int] = 1, seed: int = 3, grouped: bool = False) -> Index:
    """Fit lists on a sample of 32 rows a list, at most ``sample`` rows a group, and count what they hold.

    A group of n rows has sqrt(n) lists, or n / 2048 where that is more, up to an eighth of ``sample``; a list of more than
    ``block`` rows is held in blocks. With ``probes`` > 1 a row counts in each of its closest lists. ``grouped``, lists
    close to each other share a cell of at most ``block`` rows, or of a 64th of the group up to 65,536.
    The sample is chosen by a hash of the id. The driver sees the sample and one count per list, never a row more.
    """
    counts = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    lists_of = {g: max(1, min(max(math.ceil(math.sqrt(n)), n // 2048), sample // 8, n // 8)) for g, n in counts.items()}
    centroids, first, uppers, starts, total = {}, {}, {}, {}, 0
    if counts:
        share = {g: min(1.0, 0.9 * min(sample, max(4096, 32 * lists_of[g])) / n) for g, n in counts.items()}
        shares = F.create_map(*[F.lit(v) for g, s in share.items() for v in (g, s)])
        hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < shares[F.col("grp")] * (1 << 30)
        got = rows.filter(hashed).select("id", "grp", "vec").toArrow()
        missing = sorted(set(counts) - set(got.column("grp").unique().to_pylist()))
        if missing:  # groups of a few rows
            one = rows.filter(F.col("grp").isin(*missing)).groupBy("grp").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("id"))
            got = pa.concat_tables([got, one.select("id", "grp", "vec").toArrow()])
        got = got.sort_by("id").combine_chunks()
        for g in sorted(counts):
            x = as_matrix(got.filter(pa.compute.equal(got.column("grp"), g)).column("vec").combine_chunks())
            centroids[g], uppers[g], starts[g] = _levels(x, max(1, min(lists_of[g], len(x) // 8)), seed)
            first[g] = total
            total += len(centroids[g])
    bare = Index(centroids, first, uppers, starts, np.zeros(total, np.int64), np.ones(total, np.int64), np.zeros(total, np.int64))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(total, np.int64)
        for g, _, x in by_group(batches):
            held += np.bincount(bare.nearest(g, x, of(probes, g)).reshape(-1), minlength=total)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["list", "n"])

    found = rows.select("id", "grp", "vec").mapInArrow(lists, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    held = np.zeros(total, np.int64)
    for r in found.collect():
        held[r["list"]] = r["n"]
    blocks, cells, cell = np.ones(total, np.int64), np.zeros(total, np.int64), 0
    for g, c in centroids.items():
        most = min(1 << 16, max(block, counts[g] // 64)) if grouped else block
        blocks[first[g] : first[g] + len(c)] = np.maximum(1, -(-held[first[g] : first[g] + len(c)] // most))
        room = 0  # rows that the open cell still takes
        for k in (_chain(c) if grouped else np.arange(len(c))) + first[g]:
            if not grouped or blocks[k] > 1 or held[k] > room:
                cells[k], cell = cell, cell + blocks[k]
                room = max(0, most - held[k]) if blocks[k] == 1 else 0
            else:
                cells[k], room = cell - 1, room - held[k]
    return Index(centroids, first, uppers, starts, held, blocks, cells)


def _chain(c: np.ndarray) -> np.ndarray:
    """An order of the centroids in which each is followed by the closest that is left."""
    if len(c) > FLAT:  # lists of one upper centroid stand together already
        return np.arange(len(c))
    order, left, at = np.zeros(len(c), np.int64), np.ones(len(c), bool), 0
    for k in range(1, len(c)):
        left[at] = False
        at = order[k] = int(np.where(left, c @ c[at], -9).argmax())
    return order


def by_cell(rows: DataFrame, copies: float, *more: str) -> DataFrame:
    """Rows partitioned and sorted by cell, in parts of about 16 MB if there are ``copies`` vectors of some 300 bytes."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(copies * 300 / (1 << 24)))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell", *more)


def of_group(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(group, its rows) of a batch, in order of the group."""
    group = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in sorted(set(group.tolist())):
        yield g, batch.take(pa.array(np.flatnonzero(group == g)))


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, ids, matrix) of each group in each batch of (id, grp, vec)."""
    for batch in batches:
        for g, mine in of_group(batch):
            yield g, mine.column("id").to_numpy(), as_matrix(mine.column("vec"))


def column_blocks(length: int) -> list[int]:
    """Ends of the column blocks: a quarter of the columns, half, all."""
    return sorted({max(8, length // 4), max(8, length // 2), length} - {n for n in (8,) if n > length})


def adaptive_scan(q: np.ndarray, b: np.ndarray, bound: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the candidates never abandoned, with a squared distance within ``bound[i]``."""
    length = q.shape[1]
    ends = [e for e in column_blocks(length) if e <= length]
    i = j = d2 = None
    start = 0
    for end in ends:
        qs, bs = q[:, start:end], b[:, start:end]
        if i is None:
            part = np.einsum("ij,ij->i", qs, qs)[:, None] + np.einsum("ij,ij->i", bs, bs)[None] - 2 * (qs @ bs.T)
            if end == length:
                i, j = np.nonzero(part <= bound[:, None])
            else:
                slack = (1 + eps / math.sqrt(end)) ** 2 * end / length
                i, j = np.nonzero(part <= bound[:, None] * slack)
            d2 = part[i, j]
        else:
            more = np.empty(len(i), np.float32)
            for a in range(0, len(i), 1 << 16):
                s = slice(a, a + (1 << 16))
                gap = qs[i[s]] - bs[j[s]]
                more[s] = np.einsum("ij,ij->i", gap, gap)
            d2 = d2 + more
            slack = 1.0 if end == length else (1 + eps / math.sqrt(end)) ** 2 * end / length
            keep = d2 <= bound[i] * slack
            i, j, d2 = i[keep], j[keep], d2[keep]
        start = end
    return i, j, 1 - d2 / 2


def first_k(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest values of each group, ties by the smaller ``tie``."""
    order = np.lexsort((tie, -value, group))
    g = group[order]
    start = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1]) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def cells_of(batches: Iterator[pa.RecordBatch], step: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Walk rows (cell, role, id, vec, least) sorted by cell and role; role 0 is kept for the cell, the rest is handed to ``step``."""
    cell, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, roles = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
        for a, z in _runs(cells * 2 + roles):
            if cells[a] != cell:
                cell, kept = cells[a], []
            ids, x = batch.column("id").slice(a, z - a).to_numpy(), batch.column("vec").slice(a, z - a)
            if roles[a] == 0:
                kept.append((ids, x))
            elif kept:
                yield from step(ids, x, kept, batch.column("least").slice(a, z - a).to_numpy(zero_copy_only=False))
