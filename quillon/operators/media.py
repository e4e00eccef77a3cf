"""Media similarity: codebooks, histograms, TF-IDF over words or columns, and k-NN two ways."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import basename, l1_normalised, let
from quillon.runtime import stage

#: Path columns by preference.
PATH_COLUMNS = ("audio_path", "image_path", "file_path", "path")


def path_column(df: DataFrame) -> str:
    """The column of media paths: one of the usual names, else the first whose name has ``path`` or ``file``."""
    for name in PATH_COLUMNS:
        if name in df.columns:
            return name
    for name in df.columns:
        if "path" in name.lower() or "file" in name.lower():
            return name
    raise ValueError(f"no path column among {df.columns}")


def long_form(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, x): one row per element; null vectors and elements give none."""
    v = F.posexplode(F.col(f"`{vector_col}`").cast("array<double>"))
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("dim", "x")).filter("x is not null")


def scaler(df: DataFrame, vector_col: str) -> DataFrame:
    """One row (means, deviations): mean and population deviation of each column, 1 where it does not vary."""
    stats = df.select(F.posexplode(F.col(f"`{vector_col}`").cast("array<double>")).alias("dim", "x")).groupBy("dim")
    stats = stats.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("stats"))
    return packed.select(F.transform("stats", lambda r: r["m"]).alias("means"), F.transform("stats", lambda r: r["s"]).alias("deviations"))


def _fixed(spark: SparkSession, one: DataFrame) -> list[list[float]]:
    """The arrays of a one-row table, as long as a vector; for use as literals."""
    row = one.first()
    return [list(x or []) for x in row] if row else [[] for _ in one.columns]


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scaled(vector: Column, means: Sequence[float], deviations: Sequence[float]) -> Column:
    """The vector less the means, by the deviations."""
    less = F.zip_with(vector.cast("array<double>"), _array(means), lambda x, m: x - m)
    return F.zip_with(less, _array(deviations), lambda x, s: x / s)


def direct_histogram(vector: Column) -> Column:
    """A scaled vector shifted to a least value of 0 and a sum of 1."""
    return l1_normalised(let(vector, lambda v: let(F.array_min(v), lambda low: F.transform(v, lambda x: x - low))))


def histograms(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, histogram) of feature vectors taken directly: scaled, shifted, normalised. Null vectors give none."""
    rows = df.filter(F.col(f"`{vector_col}`").isNotNull())
    means, deviations = _fixed(df.sparkSession, scaler(rows, vector_col))
    h = direct_histogram(scaled(F.col(f"`{vector_col}`"), means, deviations))
    return rows.select(F.col(f"`{id_col}`").alias("id"), h.alias("histogram"))


def assigned_words(df: DataFrame, id_col: str, descriptor_col: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(id, word) of each descriptor: the number of the closest centroid, the first of equally close ones; null for a null or one of another length.

    One matrix product a batch; the centroids, words times columns, go to the workers.
    """
    c = np.asarray(centroids, np.float64).reshape(len(centroids), -1)
    half = np.einsum("ij,ij->i", c, c) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            fits = pc.fill_null(pc.equal(pc.list_value_length(v), c.shape[1]), False).to_numpy(zero_copy_only=False)
            x = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            words = np.zeros(len(v), np.int32)
            at = np.flatnonzero(fits)
            for a in range(0, len(at), 4096):
                words[at[a : a + 4096]] = (half - x[a : a + 4096] @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, mask=~fits)], ["id", "word"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{descriptor_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, word int")


def bag_of_words(words: DataFrame, n_words: int) -> DataFrame:
    """(id, histogram): the share of each word among an item's descriptors."""
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)) / F.col("total"))
    return packed.select("id", share.alias("histogram"))


def fit_codebook(df: DataFrame, descriptor_col: str, n_words: int = 256, seed: int = 42) -> list[list[float]]:
    """Centroids of k-means over all descriptors, in the scaled space of :func:`scaler`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(f"`{descriptor_col}`").isNotNull())
    means, deviations = _fixed(df.sparkSession, scaler(rows, descriptor_col))
    data = rows.select(array_to_vector(scaled(F.col(f"`{descriptor_col}`"), means, deviations)).alias("features"))
    return [c.tolist() for c in KMeans(k=n_words, seed=seed, maxIter=20).fit(data).clusterCenters()]


def media_idf(hist: DataFrame, n_docs: int) -> DataFrame:
    """(dim, df, idf): ln(N / (df + 1)) + 1 of each word, df being the items that have it."""
    rows = hist.select(F.posexplode("histogram").alias("dim", "x"))
    counted = rows.groupBy("dim").agg(F.sum((F.col("x") > 0).cast("long")).alias("df"))
    return counted.withColumn("idf", F.log(F.lit(float(n_docs)) / (F.col("df") + 1)) + 1)


def _weighted(histogram: Column, idf: Sequence[float]) -> Column:
    """Histogram times idf at length 1; unchanged where the lengths differ."""
    size = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda w: let(size(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w))
    return F.when(F.size(histogram) == len(idf), let(F.zip_with(histogram, _array(idf), lambda x, i: x * i), unit)).otherwise(histogram)


@dataclass
class MediaIndex:
    """Weighted vectors (id, vec) and postings (dim, id, w) of a media table, and what turns a feature into such a vector."""

    vectors: DataFrame
    postings: DataFrame
    means: list[float]
    deviations: list[float]
    idf: list[float]
    n_docs: int

    def vector_of(self, feature: Column) -> Column:
        """A feature as the index holds it."""
        return _weighted(direct_histogram(scaled(feature, self.means, self.deviations)), self.idf)

    def save(self, path: str) -> None:
        """Write the index; it replaces what is at the path."""
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.postings.repartitionByRange("dim").sortWithinPartitions("dim", "id").write.mode("overwrite").parquet(f"{path}/postings")
        about = [(self.means, self.deviations, self.idf, self.n_docs)]
        schema = "means array<double>, deviations array<double>, idf array<double>, n_docs long"
        self.vectors.sparkSession.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MediaIndex:
        """An index written by :meth:`save`."""
        a = spark.read.parquet(f"{path}/about").first()
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls(read("vectors"), read("postings"), list(a["means"]), list(a["deviations"]), list(a["idf"]), a["n_docs"])


def build_index(df: DataFrame, id_col: str, vector_col: str) -> MediaIndex:
    """Index feature vectors directly. Items without a vector are left out."""
    rows = df.filter(F.col(f"`{vector_col}`").isNotNull())
    means, deviations = _fixed(df.sparkSession, scaler(rows, vector_col))
    h = direct_histogram(scaled(F.col(f"`{vector_col}`"), means, deviations))
    hist = stage(rows.select(F.col(f"`{id_col}`").alias("id"), h.alias("histogram")), "histograms")
    return index_histograms(hist, means, deviations)


def index_histograms(hist: DataFrame, means: Sequence[float] = (), deviations: Sequence[float] = ()) -> MediaIndex:
    """Index histograms (id, histogram), however they were made."""
    n_docs = hist.count()
    idf = [r["idf"] for r in media_idf(hist, n_docs).orderBy("dim").collect()]  # as long as a histogram
    vectors = stage(hist.select("id", _weighted(F.col("histogram"), idf).alias("vec")), "media_vectors")
    postings = vectors.select("id", F.posexplode("vec").alias("dim", "w")).filter("w > 0").select("dim", "id", "w")
    return MediaIndex(vectors, stage(postings, "media_postings"), list(means), list(deviations), idf, n_docs)


def _query(index: MediaIndex, feature: Sequence[float] | None, item_id) -> list[float]:
    if feature is not None:
        one = index.vectors.sparkSession.createDataFrame([([float(x) for x in feature],)], "f array<double>")
        return list(one.select(index.vector_of(F.col("f"))).first()[0])
    row = index.vectors.filter(F.col("id") == F.lit(item_id)).select("vec").first()
    if row is None:
        raise ValueError(f"no item {item_id!r} in the index")
    return list(row[0])


def similarities(index: MediaIndex, vector: Sequence[float], method: str = "inverted") -> DataFrame:
    """(id, similarity): cosine of every item (``sequential``) or of every item sharing a word (``inverted``) with a vector."""
    size = sum(x * x for x in vector) ** 0.5 or 1.0
    if method == "sequential":
        q = _array([x / size for x in vector])
        dot = F.aggregate(F.zip_with("vec", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        own = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        return index.vectors.select("id", F.when(own > 0, dot / own).otherwise(F.lit(0.0)).alias("similarity"))
    if method == "inverted":
        words = [(k, x / size) for k, x in enumerate(vector) if x > 0]
        q = index.vectors.sparkSession.createDataFrame(words, "dim int, q double")
        hits = index.postings.join(F.broadcast(q), "dim")  # no longer than a vector
        # stored vectors have length 1
        return hits.groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("similarity"))
    raise ValueError(f"method is 'sequential' or 'inverted', not {method!r}")


def knn(index: MediaIndex, *, feature: Sequence[float] | None = None, item_id=None, k: int = 10, method: str = "inverted") -> DataFrame:
    """(rank, id, similarity): the k most similar items to a feature or an item, ties by id; six decimals."""
    scored = similarities(index, _query(index, feature, item_id), method)
    best = scored.withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))  # of k rows
    return best.select(rank.alias("rank"), "id", "similarity")


def threshold(index: MediaIndex, *, feature: Sequence[float] | None = None, item_id=None, least: float = 0.1, method: str = "inverted") -> DataFrame:
    """(id, similarity): all items of at least that similarity, best first."""
    scored = similarities(index, _query(index, feature, item_id), method).withColumn("similarity", F.round("similarity", 6))
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id")


def with_metadata(found: DataFrame, table: DataFrame, path_col: str, found_path: str = "path") -> DataFrame:
    """Results with the row of the table of the same path, else of the same file name; unmatched ones keep nulls.

    Of several rows that match equally, the one of least path serves.
    """
    keyed = table.withColumn("_full", F.col(f"`{path_col}`")).withColumn("_base", basename(F.col(f"`{path_col}`"))).filter("_full is not null")
    columns = [c for c in table.columns if c not in found.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    by_full = keyed.groupBy("_full").agg(F.min(F.struct(F.to_json(row).alias("o"), row.alias("r"))).alias("m")).select("_full", F.col("m.r").alias("_exact"))
    by_base = keyed.groupBy("_base").agg(F.min(F.struct("_full", row.alias("r"))).alias("m")).select("_base", F.col("m.r").alias("_near"))
    both = found.join(by_full, found[found_path] == F.col("_full"), "left").join(by_base, basename(found[found_path]) == F.col("_base"), "left")
    match = F.coalesce("_exact", "_near")
    return both.select(*[found[c] for c in found.columns], *[match[c].alias(c) for c in columns])


def index_stats(index: MediaIndex) -> DataFrame:
    """One row: n_objects, n_words, n_postings, sparsity, mean_norm, avg_postings_per_word."""
    posted = index.postings.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dim").alias("words")).first()
    n, words = posted["n"], posted["words"]
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return index.vectors.agg(
        F.count(F.lit(1)).alias("n_objects"), F.lit(words).alias("n_words"), F.lit(n).alias("n_postings"),
        F.round(1 - F.lit(n) / F.sum(F.size("vec")), 6).alias("sparsity"), F.round(F.avg(size), 6).alias("mean_norm"),
        F.round(F.lit(n / words if words else 0.0), 6).alias("avg_postings_per_word"),
    )
