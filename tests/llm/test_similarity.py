import glob
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import clusters, near_duplicates, neighbours, queries
from quillon.llm import vectors as V

from ..conftest import rows
from ..test_queries import DATA, _norm

# near duplicates

OPTIONS = {"similarity": (7, 10), "min_words": 5}


def _records():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [r.sample(words, 40) for _ in range(40)]
    out = []
    for k in range(260):
        text = list(base[min(k % 120, 39) if k % 3 else 0])  # one text has a third of all records
        for _ in range(r.choice([0, 0, 1, 3, 6, 12])):
            text[r.randrange(len(text))] = r.choice(words)
        r.shuffle(text)
        out.append((k, " ".join(text), r.choice([None, "", "W1 w2!"])))
    return [*out, (900, None, None), (901, "", None), (902, "few words", None), (903, "word " * 50000 + " ".join(words[:9]), None), (904, out[0][1], out[0][2])]


def _sets(data):
    import re

    got = {i: frozenset(re.findall(r"[^\W_]+", " ".join(x for x in v if x is not None).lower())) for i, *v in data}
    return {i: s for i, s in got.items() if len(s) >= 5}


def _truth(sets):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [16384, 7])
def test_pairs_equal_brute_force(spark, block):
    data = _records()
    df = spark.createDataFrame(data, "row_id long, a string, b string").withColumn("id", F.lit(0)).withColumn("words", F.lit("z")).withColumn("key", F.lit(1))
    got = {(r.row_id_a, r.row_id_b) for r in near_duplicates.pairs(df, "row_id", ["a", "b"], block=block, **OPTIONS).collect()}
    want = _truth(_sets(data))
    assert got <= want and len(got) >= 0.998 * len(want)
    assert (0, 904) in got


def test_groups_are_the_components(spark):
    data = _records()
    sets = _sets(data)
    df = spark.createDataFrame(data, "row_id long, a string, b string")
    got = {r.row_id: r for r in near_duplicates.groups(df, "row_id", ["a", "b"], **OPTIONS).collect()}
    pairs = {(r.row_id_a, r.row_id_b) for r in near_duplicates.pairs(df, "row_id", ["a", "b"], **OPTIONS).collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    low = defaultdict(lambda: 10**9)
    for i in sets:
        low[root(i)] = min(low[root(i)], i)
    assert {i: (r.group_id, r.n_links) for i, r in got.items()} == {i: (low[root(i)], links[i]) for i in sets}
    assert all(got[i].class_id == min(j for j in sets if sets[j] == sets[i]) for i in sets)


def test_no_records(spark):
    df = spark.createDataFrame([], "row_id long, a string")
    assert near_duplicates.pairs(df, "row_id", ["a"], **OPTIONS).count() == 0
    assert near_duplicates.groups(df, "row_id", ["a"], **OPTIONS).count() == 0


# vectors

LENGTHS = {"image": 32, "audio": 16}


def _media():
    rng = np.random.default_rng(1)
    out, at = [], 0
    for grp, d in LENGTHS.items():
        centres = rng.standard_normal((12, d))
        for k in range(700):
            c = 0 if k % 3 == 0 else k % 40  # one cluster has a third of all rows
            x = rng.standard_normal(d) if c >= 12 else centres[c] + 0.15 * rng.standard_normal(d)
            out.append((at, grp, (x * rng.uniform(0.1, 9)).tolist()))
            at += 1
        for k in range(25):
            out.append((at, grp, [v + 1e-3 for v in out[at - 600][2]]))
            at += 1
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31, [1.0] * 31 + [None], [float("inf")] * 32]
    return out + [(9000 + k, "image", v) for k, v in enumerate(bad)] + [(9100, "other", [1.0] * 32), (9101, None, [1.0] * 32)]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(_media(), "vec_id long, medium string, feature array<float>").withColumn("id", F.lit(0)).withColumn("vec", F.lit("z")).cache()


def _unit():
    by = defaultdict(list)
    for i, g, v in _media():
        if i < 9000:
            by[g].append((i, np.array(v, np.float64)))
    return {g: (np.array([i for i, _ in v]), np.array([x / np.linalg.norm(x) for _, x in v])) for g, v in by.items()}


ARGS = ("vec_id", "medium", "feature", LENGTHS)


def test_unusable_rows_stay_out(spark, media):
    assert V.prepared(media, *ARGS).count() == 1450


@pytest.mark.parametrize("block", [4096, 50])
def test_similar_pairs_equal_brute_force(spark, media, block):
    got = {(r.vec_id_a, r.vec_id_b) for r in neighbours.similar_pairs(media, *ARGS, min_cosine=0.99995, k=8, block=block).collect()}
    want = {(a, b) for ids, x in _unit().values() for a, b in zip(*(ids[k] for k in np.nonzero(np.triu(x @ x.T >= 0.99995, 1))), strict=True)}
    near = {(a, b) for ids, x in _unit().values() for a, b in zip(*(ids[k] for k in np.nonzero(np.triu(x @ x.T >= 0.99985, 1))), strict=True)}
    assert got <= near and len(got & want) >= 0.98 * len(want) and len(want) >= 20


def test_nearest_has_high_recall_and_keeps_the_order(spark, media):
    got = defaultdict(list)
    for r in neighbours.nearest(media, *ARGS, k=8, probes=12, query_filter="id % 20 = 0").orderBy("id", "rank").collect():
        got[r.id].append((r.neighbour, r.cosine))
    hits = total = 0
    for ids, x in _unit().values():
        g = x @ x.T
        np.fill_diagonal(g, -2)
        for k in np.flatnonzero(ids % 20 == 0):
            best = set(ids[np.argsort(-g[k])[:8]])
            hits += len(best & {n for n, _ in got[ids[k]]})
            total += 8
            assert [c for _, c in got[ids[k]]] == sorted((c for _, c in got[ids[k]]), reverse=True)
    assert hits >= 0.95 * total


@pytest.mark.parametrize("block", [4096, 40])
def test_clusters_equal_the_isolated_cliques(spark, media, block):
    data, members = clusters.clusters(media, *ARGS, threshold=0.8, min_size=3, block=block)
    got = {r.id: r.cluster_id for r in members.collect()}
    want = {}
    for ids, x in _unit().values():
        near = x @ x.T >= 0.8
        for k in range(len(ids)):
            mine = np.flatnonzero(near[k])
            if len(mine) >= 3 and near[np.ix_(mine, mine)].all() and (near[mine].sum(1) == len(mine)).all():
                want[ids[k]] = ids[mine].min()
    assert len(want) > 400 and sum(got.get(i) == c for i, c in want.items()) >= 0.99 * len(want)
    told = {r.cluster_id: r for r in clusters.described(data, members).collect()}
    assert sum(r["size"] for r in told.values()) == len(got)
    assert all(got[m] == c for c, r in told.items() for m in r.medoids)


def test_empty_tables(spark, media):
    none = media.limit(0)
    assert neighbours.nearest(none, *ARGS).count() == 0
    data, members = clusters.clusters(none, *ARGS)
    assert members.count() == 0 and clusters.described(data, members).count() == 0


def test_rotation_keeps_lengths_and_scan_keeps_what_it_must():
    q = V.rotation(24, 5)
    assert np.allclose(q @ q.T, np.eye(24), atol=1e-5)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.02 * rng.standard_normal(x.shape).astype(np.float32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    i, j, c = V.adaptive_scan(x, y, np.full(300, 2 - 2 * 0.95, np.float32), 2.1)
    assert {(a, a) for a in range(300)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and np.allclose(c, np.einsum("ij,ij->i", x[i], y[j]), atol=1e-4)


# registered queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert _norm(got) == _norm(con.sql(sql).df())
    assert len(got) > 0 or name == "p2_found"
    assert rows(spark.createDataFrame([(1,)], "a int")) == [(1,)]


def test_copies_are_neighbours_in_order_of_id(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    data = [(k, "audio", base[0 if k % 3 == 0 else k % 60].tolist()) for k in range(300)]  # one vector has a third of all rows
    df = spark.createDataFrame(data, "vec_id long, medium string, feature array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, *ARGS, k=8, probes=99, block=20).orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    x = np.array([v for _, _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(300):
        sims = np.round(x @ x[k], 6)
        want = [int(i) for i in np.lexsort((np.arange(300), -sims)) if i != k][:8]
        same = [i for i in want if sims[i] == 1.0]
        assert got[k][: len(same)] == same and len(got[k]) == 8
    assert [i for i in range(0, 27, 3)][1:] == got[0]
    asked = neighbours.nearest(df, *ARGS, k=2, probes=99, query_filter="id = 6").collect()
    assert sorted((r.id, r.neighbour) for r in asked) == [(6, 0), (6, 3)]


def test_nearest_of_many_lists_are_found(spark, tmp_path):
    """With 200 lists; probing 128 of them loses neighbours of rows that lie in no cluster."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40000, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows_ = pa.table({"vec_id": np.arange(40000), "medium": ["image"] * 40000, "feature": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 128).cast(pa.list_(pa.float32()))})
    pq.write_table(rows_, tmp_path / "media_features.parquet")
    got = defaultdict(set)
    for r in queries.p4_nearest(spark, str(tmp_path)).collect():
        got[r.vec_id].add(r.neighbour)
    asked = np.arange(0, 40000, 20)
    sim = x[asked] @ x.T
    sim[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-sim, 8, axis=1)[:, :8]
    hits = sum(len(got[a] & set(b.tolist())) for a, b in zip(asked.tolist(), best, strict=True))
    assert set(got) == set(asked.tolist()) and hits >= 0.98 * best.size, hits / best.size


def test_rows_of_different_blocks_meet(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 32))
    data = [(k, "image", (centres[k % 30] + 0.05 * rng.standard_normal(32)).tolist()) for k in range(90)]
    df = spark.createDataFrame(data, "vec_id long, medium string, feature array<float>")
    _, members = clusters.clusters(df, *ARGS, threshold=0.9, min_size=3, block=2)
    assert {r.id: r.cluster_id for r in members.collect()} == {k: k % 30 for k in range(90)}


def test_members_go_to_the_closest_pivot(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, "audio", v.tolist()) for k, v in enumerate(x)], "vec_id long, medium string, feature array<float>")
    _, members = clusters.clusters(df, *ARGS, threshold=0.6, min_size=1)
    pivot = {r.id: r.pivot for r in members.collect()}
    heads = np.array(sorted(set(pivot.values()) | {i for i, p in pivot.items() if i == p}))
    sim = x @ x[heads].T
    rest = [k for k in range(3000) if k not in set(heads.tolist()) and sim[k].max() >= 0.61]
    right = sum(k in pivot and x[k] @ x[pivot[k]] >= sim[k].max() - 0.002 for k in rest)
    assert len(rest) > 500 and right >= 0.99 * len(rest), right / len(rest)
