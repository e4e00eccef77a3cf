import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import features, media, text

from .conftest import rows


def test_simple_analyzer(spark):
    df = spark.createDataFrame([("pingüino canción abc123 foo_bar Más que mas el Niño",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.simple_tokens(F.col("t"))).collect()]
    assert got == [["cancion", "mas", "mas", "nino"], [], []]


def test_full_analyzer_drops_addresses_and_numbers(spark):
    df = spark.createDataFrame([("Ünï x http://a.b/c me@x.org 123 r2d2, niño!",)], "t string")
    assert df.select(text.full_tokens(F.col("t"))).first()[0] == ["uni", "r2d2", "nino"]


def test_weight_by_hand(spark):
    counts = spark.createDataFrame([(1, "a", 10, 10), (2, "a", 1, 1), (1, "b", 1, 11)], "doc_id int, term string, n long, total long")
    got = {(r.doc_id, r.term): r.weight for r in text.weights(counts, 4).collect()}
    assert round(got[1, "a"], 5) == 0.60206
    assert (1, "x") not in {(r.doc_id, r.term) for r in text.weights(counts.withColumn("term", F.lit("x")).limit(1), 1).collect()}


def _brute(docs, query, k):
    import collections

    words = {i: collections.Counter(w for w in t.lower().split() if len(w) > 2 and w.isalpha()) for i, t in docs}
    words = {i: c for i, c in words.items() if c}
    df = collections.Counter(w for c in words.values() for w in c)
    idf = {w: math.log10(len(words) / n) for w, n in df.items()}
    vec = lambda c: {w: (1 + math.log10(n)) * idf.get(w, 0) for w, n in c.items() if idf.get(w, 0) > 0}
    q = vec(collections.Counter(query.split()))
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    scored = [(i, sum(q.get(w, 0) * x for w, x in vec(c).items()) / (size(q) * size(vec(c)))) for i, c in words.items() if size(vec(c)) and size(q)]
    return sorted([(i, round(s, 4)) for i, s in scored if s > 0], key=lambda x: (-x[1], x[0]))[:k]


def test_search_equals_brute_force_and_survives_saving(spark, tmp_path):
    docs = [(1, "red moon over sea"), (2, "red red sun"), (3, ""), (4, "blue moon blue"), (5, "red moon over sea"), (6, None)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id int, text string, score string, term string")
    index = text.build_index(df, "doc_id", ["text", "absent"])
    want = _brute([(i, t) for i, t in docs if t], "red moon", 10)
    assert [(r.doc_id, r.score) for r in text.search(index, "red moon").collect()] == want
    assert want[0][1] == want[1][1]  # a tie, by id
    many = spark.createDataFrame([(7, "red moon"), (8, "nothing known"), (9, None)], "query_id int, query string")
    assert [(r.doc_id, r.score) for r in text.search_many(index, many).orderBy("rank").collect()] == want
    index.save(str(tmp_path / "i"))
    assert [(r.doc_id, r.score) for r in text.search(text.TextIndex.load(spark, str(tmp_path / "i")), "red moon").collect()] == want
    assert text.search(index, "").count() == 0 and text.search(index, "zebra").count() == 0
    assert text.index_stats(index).first().total_documents == 4
    with pytest.raises(ValueError):
        text.build_index(df, "doc_id", ["absent"])


def test_empty_table_has_an_empty_index(spark):
    index = text.build_index(spark.createDataFrame([], "doc_id int, text string"), "doc_id", ["text"])
    assert text.search(index, "red").count() == 0


def _vectors():
    rng = np.random.default_rng(0)
    return rng.standard_normal((40, 6)).astype(np.float32)


def _reference(x):
    z = (x - x.mean(0)) / x.std(0)
    h = z - z.min(1, keepdims=True)
    h /= h.sum(1, keepdims=True)
    w = h * (np.log(len(x) / ((h > 0).sum(0) + 1)) + 1)
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def test_knn_both_ways_equals_numpy(spark, tmp_path):
    x = _vectors()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id int, v array<float>")
    index = media.build_index(df, "id", "v")
    w = _reference(x.astype(np.float64))
    sims = w @ w[3]
    want = sorted(((k, round(float(s), 6)) for k, s in enumerate(sims)), key=lambda p: (-p[1], p[0]))[:5]
    for method in ("sequential", "inverted"):
        got = [(r.id, r.similarity) for r in media.knn(index, item_id=3, k=5, method=method).collect()]
        assert [g[0] for g in got] == [p[0] for p in want]
        assert np.allclose([g[1] for g in got], [p[1] for p in want], atol=2e-6)
    assert media.knn(index, feature=x[3].tolist(), k=1).first().id == 3
    assert {r.id for r in media.threshold(index, item_id=3, least=0.9).collect()} == {k for k, s in enumerate(sims) if round(float(s), 6) >= 0.9}
    index.save(str(tmp_path / "m"))
    assert media.knn(media.MediaIndex.load(spark, str(tmp_path / "m")), item_id=3, k=1).first().similarity == 1.0
    with pytest.raises(ValueError):
        media.knn(index, item_id=3, method="SIFT")


def test_bags_of_words(spark):
    df = spark.createDataFrame([(1, [0.1, 0.0]), (1, [0.9, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])], "id int, v array<double>")
    bags = media.bag_of_words(media.assigned_words(df, "id", "v", [[0, 0], [1, 1]]), 2)
    got = {r.id: [round(x, 3) for x in r.histogram] for r in bags.collect()}
    assert got == {1: [0.333, 0.667], 2: [1.0, 0.0]}  # a tie goes to the first word


def test_metadata_prefers_the_exact_path(spark):
    found = spark.createDataFrame([("a/1.jpg",), ("b/1.jpg",), ("c/9.jpg",)], "path string")
    table = spark.createDataFrame([("a/1.jpg", "exact"), ("z/1.jpg", "other"), (None, "none")], "image_path string, note string")
    assert rows(media.with_metadata(found, table, "image_path").select("path", "note")) == [("a/1.jpg", "exact"), ("b/1.jpg", "exact"), ("c/9.jpg", None)]


def test_sound_features(spark, tmp_path):
    import wave

    tone = (8000 * np.sin(np.arange(22050) * 2 * np.pi * 440 / 22050)).astype(np.int16)
    for name in ("a.wav", "b.wav"):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(22050)
            w.writeframes(tone.tobytes())
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.wav", "b.wav", "missing.wav")] + [(None,)], "audio_path string")
    for method, length in (("mfcc", 26), ("melspectrogram", 256), ("comprehensive", 56)):
        got = features.extract(df, "audio_path", "audio", method).collect()
        assert [len(r.feature) for r in got] == [length, length]
    f = features.comprehensive((tmp_path / "a.wav").read_bytes())
    assert abs(f[26] - 440) < 150  # the centroid of a tone
    assert f[32:44].argmax() == 0  # the pitch class of A
    with pytest.raises(ValueError):
        features.extract(df, "audio_path", "audio", "none")


def test_image_histogram():
    ppm = b"P6\n# note\n2 1\n255\n" + bytes([255, 0, 0, 255, 0, 0])
    h = features.rgb_histogram(ppm)
    assert h.shape == (48,) and h[15] > 0.5 and h[16] > 0.5
