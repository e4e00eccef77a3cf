"""Registered queries of the core operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

import io
import math
import struct
import uuid
import wave
from collections.abc import Callable

import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import functions, sources, streaming
from quillon.operators import dataprep, features, keyed, media, spatial, strict_load, text
from quillon.plans.session import Session
from quillon.runtime import shared_dir, stage, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WORDS = "copper moon tired mirror"
SONG_FIELDS = ("track_name", "track_artist", "lyrics", "track_album_name")
HERE = (48.5, 179.5)  # near the date line


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


# keyed tables


@query("SELECT * FROM region")
def scan_all(spark, d):
    return keyed.scan(table(spark, d, "region"))


@query("SELECT p_name, p_brand, '' AS p_missing FROM part")
def project_columns(spark, d):
    return keyed.project(table(spark, d, "part"), ["p_name", "p_brand", "p_missing"])


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def eq_hash_lookup(spark, d):
    return keyed.equal(table(spark, d, "orders"), "o_orderkey", 42)


@query("SELECT * FROM customer WHERE trim(c_mktsegment) = 'BUILDING'")
def eq_trimmed_any_column(spark, d):
    return keyed.equal(table(spark, d, "customer"), "C_MKTSEGMENT", "  BUILDING ")


@query("SELECT * FROM part WHERE p_size = 5")
def eq_btree_numeric(spark, d):
    return keyed.equal_number(table(spark, d, "part"), "p_size", "05")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def range_btree_numeric(spark, d):
    return keyed.in_range(table(spark, d, "orders"), "btree", "o_totalprice", 1000, 50000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_type FROM part WHERE p_type BETWEEN 'E' AND 'PROMO'")
def range_lexicographic(spark, d):
    return keyed.in_range(table(spark, d, "part"), "isam", "p_type", "E", "PROMO").select("p_partkey", "p_type")


@query("SELECT * FROM supplier ORDER BY s_name")
def ordered_scan(spark, d):
    return keyed.scan(table(spark, d, "supplier"), "sequential", "s_name")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 20")
def page_offset_limit(spark, d):
    return keyed.page(table(spark, d, "supplier").select("s_suppkey", "s_name"), [F.col("s_name"), F.col("s_suppkey")], 2, 10)


@query("SELECT * FROM nation UNION ALL SELECT 99, 'ATLANTIS', 4")
def insert_row(spark, d):
    return keyed.insert(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), [("99", "ATLANTIS", "4")])


@query("SELECT * FROM nation WHERE n_regionkey IS NULL OR n_regionkey <> 2")
def delete_by_key(spark, d):
    return keyed.delete(table(spark, d, "nation"), "n_regionkey", 2)[0]


@query("SELECT * FROM nation WHERE n_regionkey = 2")
def delete_returning(spark, d):
    return keyed.delete(table(spark, d, "nation"), "n_regionkey", 2)[1]


@query("SELECT n_name, '\"' || replace(n_name, '\"', '\"\"') || '\"' AS line FROM nation WHERE n_name LIKE '% %' UNION ALL SELECT n_name, n_name FROM nation WHERE n_name NOT LIKE '% %'")
def csv_serialised(spark, d):
    return table(spark, d, "nation").select("n_name", sources.csv_line(F.col("n_name")).alias("line"))


# places

_PLACES = "(SELECT c_custkey, ((c_custkey * 37) % 18000) / 100.0::DOUBLE - 90 AS lat, ((c_custkey * 91) % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer)"
_DIST = f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - {HERE[0]}) / 2), 2) + cos(radians({HERE[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {HERE[1]}) / 2), 2))))"


def _places(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(key, (((key * 37) % 18000) / 100.0 - 90).alias("lat"), (((key * 91) % 36000) / 100.0 - 180).alias("lon"))
    return spatial.places(rows)


@query(f"SELECT c_custkey, round({_DIST}, 3) AS dist FROM {_PLACES} WHERE {_DIST} <= 2500")
def spatial_radius(spark, d):
    return spatial.formatted(spatial.radius(_places(spark, d), *HERE, 2500.0, tie="c_custkey")).select("c_custkey", "dist")


@query(f"SELECT c_custkey, round(dist, 3) AS dist FROM (SELECT c_custkey, {_DIST} AS dist FROM {_PLACES}) ORDER BY round(dist, 6), c_custkey LIMIT 15")
def spatial_knn(spark, d):
    return spatial.formatted(spatial.nearest(_places(spark, d), *HERE, 15, tie="c_custkey")).select("c_custkey", "dist")


@query(f"SELECT count(*) AS n, round(max({_DIST}), 3) AS farthest FROM {_PLACES} WHERE {_DIST} <= 5000")
def spatial_bbox_refine(spark, d):
    near = spatial.search(_places(spark, d), *HERE, "5000.0")
    return near.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("dist"), 3).alias("farthest"))


# text

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS["spanish"] if len(w) > 2)


def _text_sql(source: str, id_col: str, expression: str) -> str:
    return f"""WITH words AS (SELECT {id_col} AS doc_id, unnest(regexp_split_to_array(translate(lower({expression}), 'áéíóúñ', 'aeioun'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS term FROM {source}),
counts AS (SELECT doc_id, term, count(*) AS n FROM words WHERE regexp_full_match(term, '[a-z]{{3,}}') AND term NOT IN ({_STOP}) GROUP BY ALL),
docs AS (SELECT doc_id, sum(n) AS total FROM counts GROUP BY doc_id),
freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
big AS (SELECT count(*)::DOUBLE AS nd FROM docs),
weights AS (SELECT doc_id, term, (1 + log10(n)) * log10(nd / df) AS weight FROM counts JOIN freq USING (term) CROSS JOIN big WHERE (1 + log10(n)) * log10(nd / df) > 0),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY doc_id)
"""


_DOC_SQL = _text_sql("documents", "doc_id", "coalesce(text, '')")
_SONG_SQL = _text_sql("spotify_songs", "row_id", "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in SONG_FIELDS) + ")")


def _search_sql(words: str) -> str:
    listed = ", ".join(f"('{w}')" for w in words.split())
    return f"""q AS (SELECT term, log10(nd / df) AS q FROM (VALUES {listed}) v(term) JOIN freq USING (term) CROSS JOIN big WHERE log10(nd / df) > 0),
qn AS (SELECT sqrt(sum(q * q)) AS qnorm FROM q),
found AS (SELECT doc_id, round(sum(weight * q) / (any_value(qnorm) * any_value(norm)), 4) AS score FROM weights JOIN q USING (term) JOIN norms USING (doc_id) CROSS JOIN qn GROUP BY doc_id)
"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    return text.term_counts(text.tokens(docs, "doc_id", ["text"]))


def _documents_index(spark: SparkSession, d: str) -> text.TextIndex:
    return text.build_index(table(spark, d, "documents"), "doc_id", ["text"])


@query(_DOC_SQL + "SELECT doc_id, term, n FROM counts")
def text_tokens(spark, d):
    return _counts(spark, d).select("doc_id", "term", "n")


@query(_DOC_SQL + "SELECT term, df FROM freq")
def text_term_df(spark, d):
    return text.document_frequencies(_counts(spark, d))


@query(_DOC_SQL + "SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def text_tfidf_weights(spark, d):
    return _documents_index(spark, d).postings.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(_DOC_SQL + "SELECT doc_id, round(norm, 6) AS norm FROM norms")
def text_doc_norms(spark, d):
    return _documents_index(spark, d).postings.groupBy("doc_id").agg(F.round(F.first("norm"), 6).alias("norm"))


@query(_DOC_SQL + "SELECT term, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc, round(sum(weight), 5) AS total FROM weights GROUP BY term")
def text_postings(spark, d):
    lists = text.posting_lists(_documents_index(spark, d).postings.select("doc_id", "term", "weight"))
    rows = lists.select("term", F.explode("postings").alias("p"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("p.doc_id").alias("first_doc"), F.max("p.doc_id").alias("last_doc"), F.round(F.sum("p.weight"), 5).alias("total"))


@query(_DOC_SQL + ", " + _search_sql(WORDS) + "SELECT doc_id, score FROM found WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def text_search_topk(spark, d):
    return text.search(_documents_index(spark, d), WORDS, 10)


@query("SELECT 1 AS query_id, rank, doc_id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (" + _SQL["text_search_topk"] + "))")
def text_search_many(spark, d):
    queries = spark.createDataFrame([(1, WORDS), (2, "de la con"), (3, None)], "query_id int, query string")
    return text.search_many(_documents_index(spark, d), queries, 10)


@query(_SONG_SQL + ", " + _search_sql("silver lantern") + "SELECT row_id, track_name, score AS similarity_score FROM found JOIN spotify_songs ON row_id = doc_id ORDER BY score DESC, row_id LIMIT 20")
def text_search_multi_field(spark, d):
    songs = table(spark, d, "spotify_songs")
    index = text.build_index(songs, "row_id", SONG_FIELDS)
    return text.fetched(songs.select("row_id", "track_name"), "row_id", text.search(index, "silver lantern", 20))


@query(_DOC_SQL + """SELECT (SELECT count(*) FROM freq) AS total_terms, (SELECT count(*) FROM docs) AS total_documents, count(*) AS total_postings,
round(count(*) / count(DISTINCT term), 6) AS avg_postings_per_term, (SELECT round(avg(df), 6) FROM freq) AS avg_df, (SELECT count(*) FROM freq WHERE df = 1) AS hapax_count FROM weights""")
def text_index_stats(spark, d):
    return text.index_stats(_documents_index(spark, d))


@query(_DOC_SQL + "SELECT doc_id, term, round(1 + log10(n), 6) AS tf_log, n::DOUBLE AS tf_raw, round(n / total, 6) AS tf_normalized FROM counts JOIN docs USING (doc_id)")
def tf_variants(spark, d):
    n, total = F.col("n"), F.col("total")
    return _counts(spark, d).select(
        "doc_id", "term", F.round(text.tf(n), 6).alias("tf_log"), text.tf(n, variant="raw").alias("tf_raw"), F.round(text.tf(n, total, "normalized"), 6).alias("tf_normalized")
    )


@query(_DOC_SQL + "SELECT doc_id, term, round(sum(weight), 6) AS weight FROM (SELECT * FROM weights UNION ALL SELECT * FROM weights) GROUP BY ALL")
def text_merge_blocks(spark, d):
    w = _documents_index(spark, d).postings.select("doc_id", "term", "weight")
    return text.merged(w, w).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def text_full_analyzer(spark, d):
    docs = text.tokens(table(spark, d, "documents"), "doc_id", ["text"], "full")
    return text.document_frequencies(text.term_counts(docs))


@query(_SQL["text_search_topk"])
def text_index_saved(spark, d):
    path = f"{shared_dir(spark)}/quillon/index-{uuid.uuid4().hex}"
    _documents_index(spark, d).save(path)
    return text.search(text.TextIndex.load(spark, path), WORDS, 10)


# media

_VEC_SQL = """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM x GROUP BY dim),
z AS (SELECT vec_id, dim, (x - m) / s AS z FROM x JOIN s USING (dim)),
u AS (SELECT vec_id, dim, z - min(z) OVER (PARTITION BY vec_id) AS u FROM z),
h AS (SELECT vec_id, dim, u / sum(u) OVER (PARTITION BY vec_id) AS h FROM u),
idf AS (SELECT dim, count(*) FILTER (h > 0) AS df, ln((SELECT count(DISTINCT vec_id)::DOUBLE FROM h) / (count(*) FILTER (h > 0) + 1)) + 1 AS idf FROM h GROUP BY dim),
w AS (SELECT vec_id, dim, h * idf AS w FROM h JOIN idf USING (dim)),
v AS (SELECT vec_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY vec_id)) AS v FROM w),
sim AS (SELECT a.vec_id AS id, round(sum(a.v * q.v), 6) AS similarity FROM v a JOIN v q ON q.dim = a.dim AND q.vec_id = 7 GROUP BY a.vec_id)
"""


def _embeddings(spark: SparkSession, d: str) -> media.MediaIndex:
    return media.build_index(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(_VEC_SQL + "SELECT vec_id, dim, round(h, 7) AS h FROM h")
def vec_scaled_histogram(spark, d):
    rows = media.histograms(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("histogram").alias("dim", "h")).withColumn("h", F.round("h", 7))


@query(_VEC_SQL + "SELECT dim, df, round(idf, 6) AS idf FROM idf")
def vec_media_idf(spark, d):
    rows = stage(media.histograms(table(spark, d, "embeddings"), "vec_id", "embedding"), "histograms")
    return media.media_idf(rows, rows.count()).select("dim", "df", F.round("idf", 6).alias("idf"))


@query(_VEC_SQL + "SELECT vec_id, dim, round(v, 6) AS v FROM v")
def vec_tfidf_l2(spark, d):
    rows = _embeddings(spark, d).vectors
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


@query(_VEC_SQL + "SELECT row_number() OVER (ORDER BY similarity DESC, id) AS rank, id, similarity FROM sim ORDER BY similarity DESC, id LIMIT 8")
def knn_sequential(spark, d):
    return media.knn(_embeddings(spark, d), item_id=7, k=8, method="sequential")


@query(_SQL["knn_sequential"])
def knn_inverted(spark, d):
    return media.knn(_embeddings(spark, d), item_id=7, k=8, method="inverted")


@query(_VEC_SQL + "SELECT id, similarity FROM sim WHERE similarity >= 0.9")
def knn_threshold(spark, d):
    return media.threshold(_embeddings(spark, d), item_id=7, least=0.9)


@query(_VEC_SQL + "SELECT row_number() OVER (ORDER BY similarity DESC, id) AS rank, 'found/' || id || '.jpg' AS path, similarity, label FROM sim JOIN embeddings ON vec_id = id ORDER BY similarity DESC, id LIMIT 8")
def knn_rank_metadata(spark, d):
    found = media.knn(_embeddings(spark, d), item_id=7, k=8)
    found = found.select("rank", F.concat(F.lit("found/"), "id", F.lit(".jpg")).alias("path"), "similarity")
    known = table(spark, d, "embeddings").select(F.concat(F.lit("data/images/"), "vec_id", F.lit(".jpg")).alias("image_path"), "label")
    return media.with_metadata(found, known, "image_path").select("rank", "path", "similarity", "label")


@query("""WITH x AS (SELECT vec_id % 50 AS id, embedding FROM embeddings),
words AS (SELECT id, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS word FROM x)
SELECT id, word, round(count(*) / sum(count(*)) OVER (PARTITION BY id), 6) AS share FROM words GROUP BY id, word""")
def bow_fixed_codebook(spark, d):
    centroids = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(8)]
    items = table(spark, d, "embeddings").withColumn("item", F.col("vec_id") % 50)
    bags = media.bag_of_words(media.assigned_words(items, "item", "embedding", centroids), 8)
    return bags.select("id", F.posexplode("histogram").alias("word", "share")).filter("share > 0").withColumn("share", F.round("share", 6))


@query()
def bow_kmeans(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("item"), F.col("embedding").alias("feature"))
    return features.codebook_index(rows, "item", 8).vectors


@query(_VEC_SQL + """SELECT (SELECT count(*) FROM embeddings) AS n_objects, count(DISTINCT dim) AS n_words, count(*) AS n_postings, round(1 - count(*) / (SELECT count(*) FROM v), 6) AS sparsity,
1.0::DOUBLE AS mean_norm, round(count(*) / count(DISTINCT dim), 6) AS avg_postings_per_word FROM v WHERE v > 0""")
def vec_stats(spark, d):
    return media.index_stats(_embeddings(spark, d))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
 / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings a JOIN embeddings q ON q.vec_id = 7""")
def vec_raw_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in rows.filter("vec_id = 7").first()["embedding"]])
    return rows.select("vec_id", F.round(functions.cosine_sim(F.col("embedding"), q), 6).alias("cosine"))


@query()
def media_methods(spark, d):
    return spark.createDataFrame([(m, n) for m, names in features.available().items() for n in names], "medium string, method string")


@query()
def media_extraction(spark, d):
    folder = f"{shared_dir(spark)}/quillon/sound-{uuid.uuid4().hex}"
    where, base = pa_fs.FileSystem.from_uri(folder)
    where.create_dir(base)
    for k in range(4):
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(22050)
            w.writeframes(b"".join(struct.pack("<h", int(9000 * math.sin(t * 0.02 * (k + 1)))) for t in range(22050)))
        with where.open_output_stream(f"{base}/{k}.wav") as out:
            out.write(held.getvalue())
    files = spark.createDataFrame([(f"{folder}/{k}.wav",) for k in range(5)], "audio_path string")
    found = features.extract(files, "audio_path", "audio", "comprehensive")
    return found.select(functions.basename(F.col("audio_path")).alias("name"), F.size("feature").alias("length"))


# joins, counts, sets


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return dataprep.joined(table(spark, d, "nation"), region, "n_regionkey").select("n_name", "r_name")


_MEDIA_BASE = "regexp_extract(media_path, '[^/\\\\]*$')"


@query(f"""WITH full_ AS (SELECT image_path AS p, min(articletype) AS f FROM fashion_complete_dataset GROUP BY 1),
base AS (SELECT regexp_extract(image_path, '[^/\\\\]*$') AS b, min(articletype) AS g FROM fashion_complete_dataset GROUP BY 1)
SELECT vec_id, coalesce(f, g) AS articletype FROM media_features LEFT JOIN full_ ON media_path = p LEFT JOIN base ON {_MEDIA_BASE} = b""")
def join_lookup_coalesce(spark, d):
    rows = table(spark, d, "media_features").select("vec_id", "media_path")
    return dataprep.looked_up(rows, table(spark, d, "fashion_complete_dataset"), "media_path", "image_path", "articletype").select("vec_id", "articletype")


@query("SELECT id, image_path FROM fashion_complete_dataset WHERE image_path IN (SELECT media_path FROM media_features)")
def join_semi(spark, d):
    return dataprep.present(table(spark, d, "fashion_complete_dataset"), table(spark, d, "media_features"), "image_path", "media_path").select("id", "image_path")


@query(f"""SELECT vec_id, media_path FROM media_features WHERE NOT EXISTS (SELECT 1 FROM fashion_complete_dataset WHERE image_path = media_path)
AND NOT EXISTS (SELECT 1 FROM fashion_complete_dataset WHERE regexp_extract(image_path, '[^/\\\\]*$') = {_MEDIA_BASE})""")
def join_anti(spark, d):
    rows = table(spark, d, "media_features").select("vec_id", "media_path")
    return dataprep.missing(rows, table(spark, d, "fashion_complete_dataset"), "media_path", "image_path")


@query("SELECT articletype, count(*) AS n FROM fashion_complete_dataset GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def value_counts(spark, d):
    return dataprep.value_counts(table(spark, d, "fashion_complete_dataset"), "articletype", 5)


@query("SELECT count(*) AS n, count(DISTINCT duration_seconds) AS n_distinct, min(duration_seconds) AS low, max(duration_seconds) AS high, round(avg(duration_seconds), 6) AS mean FROM fma_complete_dataset")
def summary_stats(spark, d):
    return dataprep.summary(table(spark, d, "fma_complete_dataset"), "duration_seconds")


@query("SELECT len(string_split(audio_path, '/')) || ' parts: ' || string_split(audio_path, '/')[1] AS shape, count(*) AS n FROM fma_complete_dataset WHERE audio_path IS NOT NULL GROUP BY 1")
def derived_key_counts(spark, d):
    return dataprep.path_shapes(table(spark, d, "fma_complete_dataset"), "audio_path")


@query("WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM x GROUP BY dim")
def column_stats(spark, d):
    return dataprep.column_stats(table(spark, d, "embeddings"), "embedding").select("dim", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _ranked_sql(words: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM found_{name} WHERE score > 0 ORDER BY r LIMIT 10)"


@query(_DOC_SQL + ", " + ", ".join(
    _search_sql(w).replace("q AS (", f"q_{n} AS (").replace("qn AS (SELECT sqrt(sum(q * q)) AS qnorm FROM q)", f"qn_{n} AS (SELECT sqrt(sum(q * q)) AS qnorm FROM q_{n})").replace("found AS", f"found_{n} AS").replace("JOIN q USING", f"JOIN q_{n} USING").replace("CROSS JOIN qn", f"CROSS JOIN qn_{n}") + ", " + _ranked_sql(w, n)
    for n, w in (("a", WORDS), ("b", "copper moon"))
) + """SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) AS n_both, count(*) AS n_either,
round(count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (a.r <= 5 AND b.r <= 5) AS overlap_at_5, count(*) FILTER (a.r <= 10 AND b.r <= 10) AS overlap_at_10
FROM a FULL JOIN b USING (doc_id)""")  # fmt: skip
def result_overlap_jaccard(spark, d):
    index = _documents_index(spark, d)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # of ten rows
    a, b = (text.search(index, q, 10).withColumn("rank", rank) for q in (WORDS, "copper moon"))
    return dataprep.overlap(a, b, "doc_id", "rank")


@query(_DOC_SQL + "SELECT DISTINCT doc_id FROM weights WHERE term IN ('copper', 'mirror')")
def set_union_candidates(spark, d):
    p = _documents_index(spark, d).postings
    return dataprep.distinct_union(*(p.filter(F.col("term") == w).select("doc_id") for w in ("copper", "mirror")))


@query("SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return dataprep.difference(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), rich)


@query("SELECT id, filename, trim(concat_ws(' ', nullif(productdisplayname, ''), nullif(gender, ''), nullif(mastercategory, ''), nullif(subcategory, ''), nullif(articletype, ''), nullif(basecolour, ''), nullif(season, ''), nullif(usage, ''))) AS combined FROM fashion_complete_dataset")
def combined_text(spark, d):
    names = ("productdisplayname", "gender", "mastercategory", "subcategory", "articletype", "basecolour", "season", "usage")
    return table(spark, d, "fashion_complete_dataset").select("id", "filename", functions.combined_text(*[F.col(c) for c in names]).alias("combined"))


@query("SELECT track_id, (duration_seconds // 60) || ':' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') AS shown, count(*) AS n FROM fma_complete_dataset GROUP BY 1, 2")
def duration_format(spark, d):
    rows = table(spark, d, "fma_complete_dataset").select("track_id", functions.minutes_seconds(F.col("duration_seconds")).alias("shown"))
    return rows.groupBy("track_id", "shown").agg(F.count(F.lit(1)).alias("n"))


# streams

_EVENT_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_EVENT_SQL)
def events_windowed(spark, d):
    rows = streaming.windowed_counts(table(spark, d, "events"), "ts", ["event_type"])
    return rows.withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events"), "ts", "user_id")


@query(_SQL["text_search_topk"])
def stream_ingest_search(spark, d):
    base = f"{shared_dir(spark)}/quillon/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.mode("overwrite").parquet(f"{base}/in")
    arriving = streaming.read_stream(spark, f"{base}/in", docs.schema)
    streaming.ingest(arriving, "doc_id", ["text"], f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return text.search(streaming.index_of(spark, f"{base}/counts", ["text"]), WORDS, 10)


# the dialect


def _session(spark: SparkSession, d: str, *names: str) -> Session:
    s = Session(spark)
    for n in names:
        s.register(n, table(spark, d, n), "btree")
    return s


@query(_DOC_SQL + ", " + _search_sql(WORDS) + "SELECT doc_id, source, score AS similarity_score FROM found JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def flagship(spark, d):
    s = Session(spark)
    s.register_text("docs", table(spark, d, "documents"), ["text"], "doc_id")
    return s.sql(f"SELECT doc_id, source FROM docs WHERE text @@ '{WORDS}' LIMIT 10")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def sql_where_order_limit(spark, d):
    return _session(spark, d, "orders").sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")


@query("SELECT * FROM (SELECT * FROM nation UNION ALL SELECT 77, 'LEMURIA', 1) WHERE n_name <> 'CANADA'")
def sql_insert_delete(spark, d):
    s = _session(spark, d, "nation")
    s.sql("INSERT INTO nation VALUES (77, 'LEMURIA', 1)")
    s.sql("DELETE FROM nation WHERE n_name = 'CANADA'")
    return s.sql("SELECT * FROM nation")


@query(f"SELECT c_custkey, round({_DIST}, 3) AS dist FROM {_PLACES} WHERE {_DIST} <= 2500")
def sql_radius(spark, d):
    s = Session(spark)
    s.register("places", _places(spark, d), "rtree")
    found = s.sql(f"SELECT c_custkey FROM places WHERE place <-> '({HERE[0]}, {HERE[1]})' < 2500")
    return found.withColumn("dist", F.round("dist", 3))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sql_plain(spark, d):
    return _session(spark, d, "nation", "region").sql("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@query(_VEC_SQL + "SELECT 'img/' || id || '.jpg' AS image_path, label, row_number() OVER (ORDER BY similarity DESC, 'img/' || id || '.jpg') AS rank, round(similarity, 4) AS similarity FROM sim JOIN embeddings ON vec_id = id ORDER BY 3 LIMIT 8")
def sql_media_search(spark, d):
    s = Session(spark)
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("img/"), "vec_id", F.lit(".jpg")).alias("image_path"), "embedding", "label")
    s.register_media("pictures", rows, "embedding")
    return s.sql('SELECT image_path, label FROM pictures WHERE embedding <-> "elsewhere/7.jpg" METHOD sequential LIMIT 8')


@query("SELECT * FROM (VALUES ('nation', 'btree', 'n_nationkey', 3), ('part', 'btree', 'p_partkey', 6), ('region', 'btree', 'r_regionkey', 2)) t(name, kind, key, columns)")
def catalog_tables(spark, d):
    return _session(spark, d, "nation", "region", "part").sql("SHOW TABLES")


# tables by kind of access: created from a file, looked up, changed


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


_PART = "(SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part)"
_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_size")


def _created(spark: SparkSession, d: str, kind: str) -> Session:
    """Parts in a table of a kind, by CREATE TABLE from a CSV file."""
    path = _folder(spark, "parts")
    sources.write_csv(table(spark, d, "part").select(*_PART_COLUMNS), path)
    s = Session(spark)
    s.sql(f"CREATE TABLE parts FROM FILE '{path}' USING INDEX {kind}(\"p_partkey\")")
    return s


def _by_kind(kind: str) -> None:
    def create(spark, d):
        return _created(spark, d, kind).sql("SELECT * FROM parts")

    def equality(spark, d):
        return _created(spark, d, kind).sql("SELECT * FROM parts WHERE p_partkey = '77'")

    def insert(spark, d):
        s = _created(spark, d, kind)
        s.sql("INSERT INTO parts VALUES ('77', 'again', 'Brand#0', '1'), ('990001', 'new', 'Brand#0', '2')")
        return s.sql("SELECT * FROM parts WHERE p_partkey = '77'").unionByName(s.sql("SELECT * FROM parts WHERE p_partkey = '990001'"))

    def delete(spark, d):
        s = _created(spark, d, kind)
        s.sql("DELETE FROM parts WHERE p_partkey = '77'")
        s.sql("DELETE FROM parts WHERE p_partkey = 'none'")
        return s.sql("SELECT * FROM parts")

    named = {
        "create": (create, f"SELECT * FROM {_PART}"),
        "equal": (equality, f"SELECT * FROM {_PART} WHERE p_partkey = '77'"),
        "insert": (insert, f"SELECT * FROM {_PART} WHERE p_partkey = '77' UNION ALL VALUES ('77', 'again', 'Brand#0', '1'), ('990001', 'new', 'Brand#0', '2')"),
        "delete": (delete, f"SELECT * FROM {_PART} WHERE p_partkey <> '77'"),
    }
    for what, (function, sql) in named.items():
        function.__name__ = f"table_{kind}_{what}"
        query(sql)(function)


for _kind in ("sequential", "isam", "hash", "btree"):
    _by_kind(_kind)


@query(f"SELECT * FROM {_PART} WHERE p_partkey BETWEEN '1' AND '19'")
def table_isam_range(spark, d):
    return _created(spark, d, "isam").sql("SELECT * FROM parts WHERE p_partkey BETWEEN '1' AND '19'")


@query(f"SELECT * FROM {_PART} WHERE p_partkey::INT BETWEEN 5 AND 40")
def table_btree_range(spark, d):
    return _created(spark, d, "btree").sql("SELECT * FROM parts WHERE p_partkey BETWEEN 5 AND 40")


def _globe(spark: SparkSession, d: str) -> Session:
    path = _folder(spark, "places")
    sources.write_csv(_places(spark, d).select("c_custkey", "lat", "lon"), path)
    s = Session(spark)
    s.sql(f"CREATE TABLE places FROM FILE '{path}' USING INDEX rtree")
    return s


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, round({_DIST}, 3) AS dist FROM {_PLACES} WHERE {_DIST} <= 2500")
def table_rtree_create(spark, d):
    found = _globe(spark, d).sql(f"SELECT c_custkey FROM places WHERE place <-> '({HERE[0]}, {HERE[1]})' < 2500")
    return found.withColumn("dist", F.round("dist", 3))


@query(f"SELECT c_custkey::VARCHAR AS c_custkey FROM {_PLACES} WHERE c_custkey = 77")
def table_rtree_equal(spark, d):
    return _globe(spark, d).sql("SELECT c_custkey FROM places WHERE c_custkey = '77'")


@query(f"SELECT c_custkey::VARCHAR AS c_custkey FROM {_PLACES} WHERE {_DIST} <= 2500 AND c_custkey <> 77 UNION ALL SELECT 'new'")
def table_rtree_change(spark, d):
    s = _globe(spark, d)
    s.sql(f"INSERT INTO places VALUES ('new', {HERE[0]}, {HERE[1]})")
    s.sql("DELETE FROM places WHERE c_custkey = '77'")
    return s.sql(f"SELECT c_custkey FROM places WHERE place <-> '({HERE[0]}, {HERE[1]})' < 2500").select("c_custkey")


@query("SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation UNION ALL SELECT generate_series::INT, NULL FROM generate_series(100, 119)")
def insert_series(spark, d):
    s = Session(spark)
    s.register("nation", table(spark, d, "nation").select("n_nationkey", "n_name"), "btree")
    s.sql("INSERT INTO nation SELECT generate_series(100, 119)")
    return s.sql("SELECT * FROM nation")


# files


@query("SELECT id::VARCHAR AS id, coalesce(productdisplayname, '') AS productdisplayname, coalesce(season, '') AS season FROM fashion_complete_dataset")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    sources.write_csv(table(spark, d, "fashion_complete_dataset").select("id", "productdisplayname", "season"), path)
    return sources.read_csv(spark, path)


@query("SELECT id::BIGINT AS id, productdisplayname, season FROM fashion_complete_dataset")
def json_round_trip(spark, d):
    path = _folder(spark, "json")
    sources.write_json(table(spark, d, "fashion_complete_dataset").select("id", "productdisplayname", "season"), path)
    return sources.read_json(spark, path).select("id", "productdisplayname", "season")


@query("SELECT * FROM (VALUES ('a.txt', 'one'), ('b.txt', 'two')) t(name, subdirectory)")
def directory_source(spark, d):
    folder = _folder(spark, "files")
    where, base = pa_fs.FileSystem.from_uri(folder)
    for name in ("one/a.txt", "two/b.txt", "two/c.wav"):
        where.create_dir(f"{base}/{name.split('/')[0]}")
        with where.open_output_stream(f"{base}/{name}") as out:
            out.write(name.encode())
    return sources.read_files(spark, folder, "*.txt", content=False).select("name", "subdirectory")


@query("SELECT 'fashion_complete_dataset' AS name, 'image_path' AS path_column UNION ALL SELECT 'fma_complete_dataset', 'audio_path' UNION ALL SELECT 'media_features', 'media_path'")
def media_path_columns(spark, d):
    names = ("fashion_complete_dataset", "fma_complete_dataset", "media_features")
    return spark.createDataFrame([(n, media.path_column(table(spark, d, n))) for n in names], "name string, path_column string")


@query("""WITH v AS (SELECT vec_id, feature::DOUBLE[] AS v FROM media_features WHERE medium = 'image' AND len(feature) = 128 AND len(list_filter(feature, lambda x: isnan(x))) = 0),
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS word, v AS c FROM (SELECT * FROM v ORDER BY vec_id LIMIT 256)),
near AS (SELECT vec_id, word, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, c), 6), word) AS r FROM v CROSS JOIN c)
SELECT vec_id, word::INT AS word FROM near WHERE r = 1""")
def words_of_256(spark, d):
    rows = table(spark, d, "media_features").filter("medium = 'image' and size(feature) = 128 and not exists(feature, x -> isnan(x))")
    words = [r["feature"] for r in rows.orderBy("vec_id").limit(256).collect()]
    return media.assigned_words(rows, "vec_id", "feature", words).withColumnRenamed("id", "vec_id")


# rows that fail to parse

_P7_SQL = """WITH raw AS (SELECT line_no, coalesce(raw_line, '') AS r FROM styles_raw),
q AS (SELECT line_no, r, regexp_full_match(r, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS ok FROM raw),
f AS (SELECT line_no, ok, list_transform(regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda v: CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') ELSE v END) AS v FROM q),
j AS (SELECT line_no, ok, v, len(v) = 10 AS shaped,
  regexp_full_match(v[1], '[0-9]{1,9}') AND v[2] IN (SELECT allowed_value FROM style_values WHERE field_name = 'gender')
  AND (v[7] = '' OR v[7] IN (SELECT allowed_value FROM style_values WHERE field_name = 'season'))
  AND regexp_full_match(v[8], '|20[01][0-9]|202[0-6]') AND regexp_full_match(v[10], '(?s).*[^\\s\\p{Z}].*') AS valid FROM f)
"""


def _styles(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "styles_raw"), "line_no", "raw_line", strict_load.STYLES, table(spark, d, "style_values")


@query(_P7_SQL + "SELECT line_no, CASE WHEN NOT ok THEN 'quoting' WHEN NOT shaped THEN 'column_count' ELSE 'invalid_value' END AS reason FROM j WHERE NOT (ok AND shaped AND coalesce(valid, false))")
def p7_found(spark, d):
    return strict_load.failures(*_styles(spark, d)).select("line_no", "reason")


@query(_P7_SQL + """SELECT line_no, v[1]::INT AS id, v[2] AS gender, v[3] AS "masterCategory", v[4] AS "subCategory", v[5] AS "articleType", v[6] AS "baseColour", v[7] AS season, v[8] AS year, v[9] AS usage, v[10] AS "productDisplayName" FROM j WHERE ok AND shaped AND valid""")
def p7_loaded(spark, d):
    rows = strict_load.strict_load(*_styles(spark, d)).drop("_mark")
    return rows.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("")))  # null shows as it came


@query(f"SELECT reason, count(*) AS n FROM ({_SQL['p7_found']}) GROUP BY reason")
def p7_reasons(spark, d):
    return strict_load.reason_counts(strict_load.failures(*_styles(spark, d)))


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have one."""
    return dict(_SQL)
