"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import clusters, distinctive, encodings, languages, mixing, near_duplicates, neighbours, sentences, tokens
from quillon.runtime import table

SONG_TEXT = ("track_name", "lyrics")
SONG_WORDS = ("track_name", "track_artist", "lyrics")
#: The full length of a vector of each medium.
LENGTHS = {"image": 128, "audio": 56}
NEAR = {"similarity": (7, 10), "min_words": 30}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.found(table(spark, sf_dir, "spotify_songs"), "row_id", ("lyrics", "track_artist"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled(table(spark, sf_dir, "spotify_songs"), "row_id", ("lyrics", "track_artist"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "spotify_songs")
    return distinctive.terms_within(songs, "row_id", SONG_TEXT, min_count=3, min_df=2, max_df=6)


def p2_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.top_terms(table(spark, sf_dir, "spotify_songs"), "row_id", SONG_TEXT, k=5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, sf_dir, "spotify_songs"), "row_id", SONG_WORDS, **NEAR)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "spotify_songs"), "row_id", SONG_WORDS, **NEAR)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media_features")
    near = neighbours.similar_pairs(media, "vec_id", "medium", "feature", LENGTHS, min_cosine=0.985, k=8, recall=0.999)
    return near.select("vec_id_a", "vec_id_b")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media_features")
    near = neighbours.nearest(media, "vec_id", "medium", "feature", LENGTHS, k=8, recall=0.985, query_filter="id % 20 = 0")
    return near.select(F.col("id").alias("vec_id"), "neighbour", "rank", F.round("cosine", 3).alias("cosine"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "spotify_songs")
    model = languages.fit(songs, "row_id", "lyrics", "lyrics_lang")
    return languages.doubtful(languages.languages(songs, "row_id", "lyrics", "lyrics_lang", model), "row_id", min_lines=8)


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "spotify_songs")
    model = languages.fit(songs, "row_id", "lyrics", "lyrics_lang")
    return languages.stretches(songs, "row_id", "lyrics", model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media_features")
    _, members = clusters.clusters(media, "vec_id", "medium", "feature", LENGTHS, threshold=0.8, min_size=3)
    return members.select(F.col("id").alias("vec_id"), "cluster_id")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media_features")
    rows, members = clusters.clusters(media, "vec_id", "medium", "feature", LENGTHS, threshold=0.8, min_size=3)
    return clusters.described(rows, members).withColumnRenamed("grp", "medium")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = tokens.decode(tokens.encode(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mixed, _ = mixing.mixed_documents(docs, targets, "doc_id", "text", "source")
    return mixed


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mixed_documents(docs, targets, "doc_id", "text", "source")[1]


def p9_held_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mixed_documents(docs, targets, "doc_id", "text", "source", total="held")[0]


def p9_held_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mixed_documents(docs, targets, "doc_id", "text", "source", total="held")[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id", "end_pos")


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", with_text=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: function
        for name, function in globals().items()
        if name[:1] == "p" and name.split("_")[0][1:].isdigit() and callable(function)
    }


_P2_COUNTS = """
WITH words AS (
  SELECT row_id, unnest(regexp_split_to_array(
    translate(lower(coalesce(track_name, '') || ' ' || coalesce(lyrics, '')), 'áéíóúñ', 'aeioun'),
    '[^\\p{L}\\p{M}\\p{N}_]+')) AS term
  FROM spotify_songs),
counts AS (
  SELECT row_id, term, count(*) AS y FROM words WHERE regexp_full_match(term, '[a-z]{3,}') GROUP BY row_id, term),
stats AS (SELECT term, count(*) AS df, sum(y) AS c FROM counts GROUP BY term)
"""


_P3_PAIRS = """
WITH words AS (
  SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', track_name, track_artist, lyrics)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w
  FROM spotify_songs),
long AS (SELECT row_id, len(w) AS n, unnest(w) AS word FROM words WHERE len(w) >= 30),
common AS (
  SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM long a JOIN long b ON a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2)
SELECT row_id_a, row_id_b FROM common WHERE o * 10 >= (na + nb - o) * 7
"""

_UNIT = """
WITH usable AS (
  SELECT vec_id, medium, feature::DOUBLE[] AS v FROM media_features
  WHERE len(feature) = CASE medium WHEN 'image' THEN 128 WHEN 'audio' THEN 56 END
  AND len(list_filter(feature, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(feature, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS cosine
  FROM usable a JOIN usable b ON a.medium = b.medium AND a.vec_id <> b.vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_PAIRS,
        "p4_found": _UNIT + "SELECT a AS vec_id_a, b AS vec_id_b FROM pairs WHERE cosine >= 0.985 AND a < b",
        "p6_found": _UNIT
        + """, near AS (SELECT a, least(a, min(b)) AS low, count(*) AS n FROM pairs WHERE cosine >= 0.8 GROUP BY a),
sized AS (SELECT a, low, n, count(*) OVER (PARTITION BY low) AS members, min(n) OVER (PARTITION BY low) AS least_n, max(n) OVER (PARTITION BY low) AS most_n FROM near)
SELECT a AS vec_id, low AS cluster_id FROM sized WHERE members >= 3 AND least_n = members - 1 AND most_n = members - 1""",
        "p8_round_trip": "SELECT true AS same, count(*) AS n FROM documents",
        "p2_found": _P2_COUNTS
        + "SELECT row_id, term FROM counts JOIN stats USING (term) WHERE y >= 3 AND df BETWEEN 2 AND 6",
        "p2_top_terms": _P2_COUNTS
        + """, sized AS (SELECT *, sum(y) OVER (PARTITION BY row_id)::DOUBLE AS n FROM counts),
total AS (SELECT sum(y)::DOUBLE AS big FROM counts),
parts AS (
  SELECT row_id, term, y::DOUBLE AS y, n, c::DOUBLE AS c, big, 1000.0 * c / big AS a
  FROM sized JOIN stats USING (term) CROSS JOIN total),
scored AS (
  SELECT row_id, term, round((
    ln((y + a) / greatest(n + 1000.0 - y - a, 1e-9))
    - ln((c - y + a) / greatest(big - n + 1000.0 - (c - y) - a, 1e-9))) / sqrt(1 / (y + a) + 1 / (c - y + a)), 6) AS z
  FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY z DESC, term) AS rank FROM scored)
SELECT row_id, rank, term, z FROM ranked WHERE rank <= 5""",
    }
