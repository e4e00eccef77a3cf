"""Ranked full-text search: analysis, TF-IDF weights, postings and cosine top-k."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.runtime import stage

# Stop words of the simple analyzer. Accents are gone before they are looked up, so "más" never meets one.
STOP_WORDS = {
    "spanish": (
        "el la de que y a en un es se no te lo le da su por son con para al del los las una como todo pero más me ya muy fue"
    ).split(),
    "english": "the a an and or but in on at to for of with by is are was were be been have".split(),
}
#: Words the full analyzer drops in any language.
EXTRA_STOP_WORDS = "el la de que y a en un es se no te lo le da su por son con para al del los las una como todo".split()
#: The letters the simple analyzer replaces.
ACCENTS, PLAIN = "áéíóúñ", "aeioun"
#: A word of three or more letters a-z, with no letter, mark, digit or underscore on either side.
_SIDE = r"[a-z0-9_\p{L}\p{M}\p{N}]"
WORD = rf"(?<!{_SIDE})[a-z]{{3,}}+(?!{_SIDE})"


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base and marks, and their bases."""
    pairs = []
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(o)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(o):
            pairs.append((chr(o), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _folding()


def fold_accents(c: Column) -> Column:
    """The text without accents: decomposed letters of the Latin blocks, combining marks dropped."""
    return F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")


def simple_tokens(text: Column, language: str = "spanish") -> Column:
    """Words of three or more letters a-z after six accents are replaced, without stop words. Null gives none."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for accented, letter in zip(ACCENTS, PLAIN, strict=True):  # faster than a translation where there is nothing to replace
        plain = F.replace(plain, F.lit(accented), F.lit(letter))
    stop = [w for w in STOP_WORDS[language if language in STOP_WORDS else "english"] if len(w) > 2]
    return F.filter(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop))


def full_tokens(text: Column, language: str = "spanish") -> Column:
    """Words without accents, addresses, bare numbers and signs; two letters or more; stop words dropped, no stemming."""
    t = fold_accents(F.lower(F.coalesce(text, F.lit(""))))
    for pattern, by in ((r"http\S+|www\S+", ""), (r"\S+@\S+", ""), (r"\b\d+\b", ""), (r"[^\p{L}\p{N}_\s]", " ")):
        t = F.regexp_replace(t, pattern, by)
    stop = sorted({*EXTRA_STOP_WORDS, *STOP_WORDS.get(language, STOP_WORDS["english"])})
    return F.filter(F.split(F.trim(t), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def stemmed_tokens(text: Column, language: str = "spanish") -> Column:
    """Full analysis followed by Snowball stemming, where a stemmer is installed on driver and workers."""
    import pandas as pd
    import snowballstemmer

    @F.pandas_udf("array<string>")
    def stemmed(parts: pd.Series) -> pd.Series:
        stemmer = snowballstemmer.stemmer(language)
        return parts.map(lambda words: stemmer.stemWords(list(words)))

    return stemmed(full_tokens(text, language))


ANALYZERS = {"simple": simple_tokens, "full": full_tokens, "stemmed": stemmed_tokens}


def joined_fields(fields: Sequence[str]) -> Column:
    """Non-empty fields of a record joined by blanks, in the order listed."""
    return F.concat_ws(" ", *[F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string")) for c in fields])


def tokens(df: DataFrame, id_col: str, fields: Sequence[str], analyzer: str = "simple", language: str = "spanish") -> DataFrame:
    """(doc_id, tokens) of the documents with at least one token."""
    analysed = ANALYZERS[analyzer](joined_fields(fields), language)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), analysed.alias("tokens")).filter(F.size("tokens") > 0)


def term_counts(token_rows: DataFrame) -> DataFrame:
    """(doc_id, term, n, total): how often each term occurs in each document, and its number of tokens."""
    rows = token_rows.select("doc_id", F.size("tokens").alias("total"), F.explode("tokens").alias("term"))
    return rows.groupBy("doc_id", "total", "term").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "term", "n", "total")


def tf(n: Column, total: Column | None = None, variant: str = "log") -> Column:
    """Term frequency: ``log`` 1 + log10(n), ``raw`` n, ``normalized`` n by all tokens."""
    if variant == "log":
        return F.lit(1.0) + F.log10(n.cast("double"))
    if variant == "raw":
        return n.cast("double")
    if variant == "normalized":
        return n / total
    raise ValueError(f"unknown variant {variant!r}")


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    """log10(N / df), 0 for a term in no document."""
    return F.when(df > 0, F.log10(n_docs.cast("double") / df)).otherwise(F.lit(0.0))


def weights(counts: DataFrame, n_docs: int, frequencies: DataFrame | None = None, variant: str = "log") -> DataFrame:
    """(doc_id, term, weight) with weights above 0, so a term of every document has none."""
    frequencies = document_frequencies(counts) if frequencies is None else frequencies
    rows = counts.join(frequencies, "term")
    weight = tf(F.col("n"), F.col("total"), variant) * idf(F.lit(n_docs), F.col("df"))
    return rows.select("doc_id", "term", weight.alias("weight")).filter("weight > 0")


def norms(weighted: DataFrame) -> DataFrame:
    """(doc_id, norm)."""
    return weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def merged(*blocks: DataFrame) -> DataFrame:
    """Postings of several blocks put together; a document's weights for one term are added."""
    every = blocks[0]
    for b in blocks[1:]:
        every = every.unionByName(b)
    return every.groupBy("term", "doc_id").agg(F.sum("weight").alias("weight"))


def posting_lists(weighted: DataFrame, size: int = 10_000) -> DataFrame:
    """(term, block, postings): lists by document id, in blocks so that no term's list is ever one value."""
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / size)).alias("block")
    df = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = weighted.join(df, "term").select("term", block, F.struct("doc_id", "weight").alias("posting"))
    return rows.groupBy("term", "block").agg(F.array_sort(F.collect_list("posting")).alias("postings"))


@dataclass
class TextIndex:
    """Derived tables of an index: postings (doc_id, term, weight, norm) and frequencies (term, df)."""

    postings: DataFrame
    frequencies: DataFrame
    n_docs: int
    fields: tuple[str, ...]
    analyzer: str = "simple"
    language: str = "spanish"

    def cache(self) -> TextIndex:
        """The index kept in memory, what does not fit on disk; ranged by term, so that a search skips most blocks."""
        postings = self.postings.repartitionByRange("term").sortWithinPartitions("term")
        return replace(self, postings=postings.persist(), frequencies=self.frequencies.persist())

    def save(self, path: str) -> None:
        """Write the index; it replaces what is at the path. Postings are ranged by term, so a search reads few row groups."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
        about = [(self.n_docs, list(self.fields), self.analyzer, self.language)]
        spark.createDataFrame(about, "n_docs long, fields array<string>, analyzer string, language string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        """An index written by :meth:`save`."""
        about = spark.read.parquet(f"{path}/about").first()
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls(read("postings"), read("frequencies"), about["n_docs"], tuple(about["fields"]), about["analyzer"], about["language"])


def build_index(df: DataFrame, id_col: str, fields: Sequence[str], analyzer: str = "simple", language: str = "spanish") -> TextIndex:
    """Index the listed fields the table has. Fields it lacks are dropped; none left is an error.

    Documents are shuffled once by id to be counted, and their counts staged. Frequencies shuffle by term what is left of the counts
    after adding up; weights join them to the counts (broadcast while they are small), and norms shuffle one partial sum a document and
    part. The postings are written once.
    """
    present = tuple(c for c in fields if c in df.columns)
    if not present:
        raise ValueError(f"none of {list(fields)} is a column")
    needed = df.select(id_col, *[c for c in present if c != id_col]).repartition(id_col)
    counts = stage(term_counts(tokens(needed, id_col, present, analyzer, language)), "counts")
    return index_counts(counts, present, analyzer, language)


def index_counts(counts: DataFrame, fields: Sequence[str], analyzer: str = "simple", language: str = "spanish") -> TextIndex:
    """The index over staged counts (doc_id, term, n, total)."""
    frequencies = stage(document_frequencies(counts), "frequencies")
    n_docs = counts.select("doc_id").distinct().count()
    weighted = weights(counts, n_docs, frequencies)
    postings = stage(weighted.join(norms(weighted), "doc_id"), "postings")
    return TextIndex(postings, frequencies, n_docs, tuple(fields), analyzer, language)


def query_weights(index: TextIndex, query: str) -> dict[str, float]:
    """Weights of the query's terms the index knows. Only these terms' frequencies come to the driver."""
    row = index.postings.sparkSession.createDataFrame(pa.table({"text": pa.array([query], pa.string())}))  # needs no job
    words = row.select(ANALYZERS[index.analyzer](F.col("text"), index.language).alias("tokens")).first()["tokens"]
    counts = {w: words.count(w) for w in words}
    if not counts:
        return {}
    known = index.frequencies.filter(F.col("term").isin(*counts)).collect()
    raw = {r["term"]: (1 + math.log10(counts[r["term"]])) * math.log10(index.n_docs / r["df"]) for r in known}
    return {t: w for t, w in raw.items() if w > 0}


def search(index: TextIndex, query: str, k: int | None = 10) -> DataFrame:
    """(doc_id, score): cosine of query and document over documents that share a term, best first, ties by id.

    An empty query, or one of unknown words, gives no rows. Scores have four decimals.
    """
    weight = query_weights(index, query)
    size = math.sqrt(sum(w * w for w in weight.values()))
    q = F.lit(0.0)
    for term, w in weight.items():
        q = F.when(F.col("term") == term, F.lit(w / size)).otherwise(q)
    hits = index.postings.filter(F.col("term").isin(*weight)) if weight else index.postings.filter("false")
    scored = hits.groupBy("doc_id").agg((F.sum(F.col("weight") * q) / F.first("norm")).alias("score")).filter("score > 0")
    best = scored.select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id")
    return best if k is None else best.limit(k)


def search_many(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the same for a table of queries (query_id, query), all in one job."""
    rows = queries.select("query_id", ANALYZERS[index.analyzer](F.col("query"), index.language).alias("tokens"))
    counts = rows.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(index.frequencies, "term").select("query_id", "term", (tf(F.col("n")) * idf(F.lit(index.n_docs), F.col("df"))).alias("q"))
    weighted = weighted.filter("q > 0")
    size = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size"))
    hits = index.postings.join(weighted.join(size, "query_id"), "term")
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("q")) / (F.first("size") * F.first("norm")), 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")


def fetched(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The documents found, with ``similarity_score`` last, best first."""
    scored = found.select(F.col("doc_id").alias(id_col), F.col("score").alias("similarity_score"))
    return df.join(scored, id_col).select(*[f"`{c}`" for c in df.columns], "similarity_score").orderBy(F.desc("similarity_score"), id_col)


def index_stats(index: TextIndex) -> DataFrame:
    """One row: total_terms, total_documents, total_postings, avg_postings_per_term, avg_df, hapax_count."""
    posted = index.postings.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms")).first()
    average = posted["n"] / posted["terms"] if posted["terms"] else 0.0
    return index.frequencies.agg(
        F.count(F.lit(1)).alias("total_terms"), F.lit(index.n_docs).alias("total_documents"), F.lit(posted["n"]).alias("total_postings"),
        F.round(F.lit(average), 6).alias("avg_postings_per_term"), F.round(F.avg("df"), 6).alias("avg_df"),
        F.coalesce(F.sum(F.when(F.col("df") == 1, 1).otherwise(0)), F.lit(0)).alias("hapax_count"),
    )
