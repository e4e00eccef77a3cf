"""A session: a catalog of tables and the statements over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import functions, sources
from quillon.operators import features, keyed, media, spatial, text
from quillon.plans import parser as P
from quillon.runtime import stage

#: Names of a text index.
TEXT_KINDS = ("spimi", "inverted", "text")


@dataclass
class Table:
    """A table of the catalog: its rows, its kind of access, its key, and its index if it has one."""

    name: str
    kind: str
    rows: DataFrame
    key: str | None = None
    index: Any = None
    path: str | None = None
    id_col: str | None = None
    #: the rows in the layout of their kind, see :func:`keyed.stored`, and how many changes were made to it since it was written
    stored: DataFrame | None = None
    changes: int = 0

    @property
    def key_column(self) -> str | None:
        """The one key column of a table in a layout."""
        return None if self.stored is None or self.kind == "rtree" else self.key


class Session:
    """Tables by name, and ``sql`` over them. Names are kept as given and found without regard to case."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}
        functions.register_sql(spark)

    # catalog

    def table(self, name: str) -> Table:
        """A table by name."""
        for known, t in self.tables.items():
            if known.lower() == name.lower():
                return t
        raise ValueError(f"no table {name!r}; there are {sorted(self.tables)}")

    def _put(self, t: Table) -> Table:
        self.tables = {k: v for k, v in self.tables.items() if k.lower() != t.name.lower()} | {t.name: t}
        t.rows.createOrReplaceTempView(t.name)
        return t

    def register(self, name: str, rows: DataFrame, kind: str = "sequential", key: str | int | None = None) -> Table:
        """A keyed table of these rows, written in the layout of its kind, which also gives the order of scans and the meaning of ranges."""
        kind = keyed.KINDS.get(kind.lower())
        if kind is None:
            raise ValueError(f"kinds are {sorted(keyed.KINDS)}")
        if kind == "rtree":
            lat, lon = spatial.coordinate_columns(rows)
            return self._store(Table(name, kind, spatial.places(rows, lat, lon), f"{lat},{lon}"))
        return self._store(Table(name, kind, rows, keyed.resolve(rows, key if key is not None else 0)))

    def _store(self, t: Table) -> Table:
        return self._put(self._with(t, keyed.stored(t.rows, t.kind, t.key)))

    @staticmethod
    def _with(t: Table, stored: DataFrame, changes: int = 0) -> Table:
        return replace(t, rows=stored.select(*[F.col(f"`{c}`") for c in t.rows.columns]), stored=stored, changes=changes)

    def compact(self, name: str) -> Table:
        """Write a table anew, without the rows that were deleted and with those added in their place."""
        return self._store(self.table(name))

    def register_text(self, name: str, rows: DataFrame, fields: Sequence[str], id_col: str | None = None, analyzer: str = "simple", language: str = "spanish") -> Table:
        """A text table; without an id column rows get one, kept apart from theirs."""
        if id_col is None:
            id_col = "_doc_id"
            rows = stage(rows.withColumn(id_col, F.monotonically_increasing_id()), "documents")
        fields = [keyed.resolve(rows, f) for f in fields if f.lower() in {c.lower() for c in rows.columns}]
        index = text.build_index(rows, id_col, fields, analyzer, language)
        return self._put(Table(name, "text", rows, ",".join(index.fields), index, id_col=id_col))

    def register_media(self, name: str, rows: DataFrame, vector_col: str, path_col: str | None = None) -> Table:
        """A media table over feature vectors at hand; items are known by their path."""
        path_col = path_col or media.path_column(rows)
        rows = rows.filter(F.col(f"`{path_col}`").isNotNull())
        index = media.build_index(rows.dropDuplicates([path_col]), path_col, vector_col)
        return self._put(Table(name, "media", rows, vector_col, index, id_col=path_col))

    def register_embeddings(self, name: str, rows: DataFrame) -> Table:
        """A table of vectors, listed and open to plain queries."""
        return self._put(Table(name, "embedding", rows, None))

    def show_tables(self, like: str | None = None) -> DataFrame:
        """(name, kind, key, columns); ``like`` keeps names that contain it, in any case."""
        rows = [(t.name, t.kind, t.key, len(t.rows.columns)) for t in self.tables.values() if like is None or like.strip("%").lower() in t.name.lower()]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "name string, kind string, key string, columns int")

    def describe(self, name: str) -> DataFrame:
        """(column, type, indexed) of a table."""
        t = self.table(name)
        keys = (t.key or "").split(",")
        return self.spark.createDataFrame([(c, k, c in keys) for c, k in t.rows.dtypes], "column string, type string, indexed boolean")

    def info(self, name: str) -> dict[str, Any]:
        """Kind, key, columns and number of rows."""
        t = self.table(name)
        return {"name": t.name, "kind": t.kind, "key": t.key, "columns": t.rows.columns, "rows": t.rows.count()}

    def stats(self, name: str) -> DataFrame:
        """Statistics of a table's index, or rows per partition of a keyed one."""
        t = self.table(name)
        if t.kind == "text":
            return text.index_stats(t.index)
        return media.index_stats(t.index) if t.kind == "media" else keyed.layout_stats(t.stored)

    def save(self, folder: str) -> None:
        """Write all tables and indices below a folder."""
        about = []
        for t in self.tables.values():
            kept = t.rows if t.stored is None else t.stored
            sources.write_parquet(kept, f"{folder}/{t.name}/rows", [keyed.BUCKET] if keyed.BUCKET in kept.columns else [])
            if t.index is not None:
                t.index.save(f"{folder}/{t.name}/index")
            about.append((t.name, t.kind, t.key, t.id_col))
        self.spark.createDataFrame(about, "name string, kind string, key string, id_col string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_catalog")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Session:
        """A session written by :meth:`save`."""
        out, kinds = cls(spark), {"text": text.TextIndex, "media": media.MediaIndex}
        for r in spark.read.parquet(f"{folder}/_catalog").collect():
            base = f"{folder}/{r['name']}"
            index = kinds[r["kind"]].load(spark, f"{base}/index") if r["kind"] in kinds else None
            rows = spark.read.parquet(f"{base}/rows")
            own = rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_q_")])
            out._put(Table(r["name"], r["kind"], own, r["key"], index, id_col=r["id_col"], stored=rows if r["kind"] in keyed.KINDS.values() else None))
        return out

    # statements

    def sql(self, statement: str) -> DataFrame:
        """Run a statement of the dialect, or of Spark SQL."""
        s = P.parse(statement)
        return getattr(self, f"_{type(s).__name__.lower()}")(s)

    def _plain(self, s: P.Plain) -> DataFrame:
        return self.spark.sql(s.text.strip().rstrip(";"))

    def _read(self, file: str, typed: bool, encoding: str) -> DataFrame:
        if file.lower().rstrip("/").endswith(".parquet"):
            return sources.read_parquet(self.spark, file)
        return sources.read_json(self.spark, file) if file.lower().endswith((".json", ".jsonl")) else sources.read_csv(self.spark, file, typed=typed, encoding=encoding)

    def _createtable(self, s: P.CreateTable) -> DataFrame:
        if s.kind in TEXT_KINDS:
            self.register_text(s.table, self._read(s.file, False, "UTF-8"), s.columns)
        else:
            self.register(s.table, self._read(s.file, False, "ISO-8859-1"), s.kind, s.columns[0] if s.columns else None)
        return self.describe(s.table)

    def _createmedia(self, s: P.CreateMedia) -> DataFrame:
        rows = self._read(s.file, True, "UTF-8")
        if s.method in rows.columns:  # features are there already
            self.register_media(s.table, rows, s.method)
        else:
            path = media.path_column(rows)
            found = features.extract(rows, path, s.medium, s.method)
            if s.method in features.DESCRIPTOR_METHODS:
                index = features.codebook_index(found, path, s.clusters)
                self._put(Table(s.table, "media", rows, s.method, index, id_col=path))
            else:
                table = self.register_media(s.table, rows.join(found, path), "feature", path)
                table.key = s.method
        return self.describe(s.table)

    def _where(self, t: Table, rows: DataFrame, w: P.Compare) -> DataFrame:
        if w.op == "=":
            rows = keyed.narrowed(rows, t.key_column, w.column, w.value)
            return keyed.equal_number(rows, w.column, w.value) if t.kind == "btree" or isinstance(w.value, (int, float)) else keyed.equal(rows, w.column, w.value)
        c = keyed.col_of(rows, w.column)
        if w.op == "between":
            numeric = isinstance(w.value, (int, float)) and isinstance(w.high, (int, float)) and t.kind not in ("sequential", "isam")
            if t.kind == "hash" and keyed.resolve(rows, w.column) == t.key:
                raise ValueError("a hash table has no range search")
            rows = keyed.narrowed(rows, t.key_column, w.column, w.value, w.high) if numeric else rows
            return keyed.between_numbers(rows, w.column, w.value, w.high) if numeric else keyed.between_strings(rows, w.column, w.value, w.high)
        key = functions.number(c) if isinstance(w.value, (int, float)) else c.cast("string")
        v = F.lit(w.value)
        return rows.filter({"<": key < v, ">": key > v, "<=": key <= v, ">=": key >= v, "<>": key != v}[w.op])

    def _select(self, s: P.Select) -> DataFrame:
        try:
            t = self.table(s.table)
        except ValueError:
            t = Table(s.table, "sequential", self.spark.table(s.table))
        special = [w for w in s.where if not isinstance(w, P.Compare)]
        if len(special) > 1:
            raise ValueError("one search a statement")
        rows, extra, order, limit = t.rows if t.stored is None else t.stored, [], [], s.limit
        for w in special:
            if isinstance(w, P.TextMatch):
                if t.kind != "text":
                    raise ValueError(f"{t.name} has no text index")
                plain = any(isinstance(x, P.Compare) for x in s.where)
                found = text.search(t.index, w.query, None if plain or s.order else (10 if limit is None else limit) + s.offset)
                rows = rows.join(found.select(F.col("doc_id").alias(t.id_col), F.col("score").alias("similarity_score")), t.id_col)
                extra, order, limit = ["similarity_score"], [F.desc("similarity_score"), F.col(t.id_col)], 10 if limit is None else limit
            elif isinstance(w, P.MediaMatch):
                limit = 10 if limit is None else limit
                rows = self._media(t, w, limit + s.offset)
                extra, order = ["rank", "similarity"], [F.col("rank")]
            else:
                lat, lon = t.key.split(",") if t.kind == "rtree" else spatial.coordinate_columns(rows)
                rows = spatial.radius(rows, w.lat, w.lon, w.radius, lat, lon)
                extra, order = ["dist"], [F.col("dist")]
        for w in s.where:
            if isinstance(w, P.Compare):
                rows = self._where(t, rows, w)
        if s.near is not None:
            if not isinstance(s.near, P.Near):
                raise ValueError("ORDER BY <-> takes a place")
            lat, lon = t.key.split(",") if t.kind == "rtree" else spatial.coordinate_columns(rows)
            rows = spatial.nearest(rows, s.near.lat, s.near.lon, (10 if limit is None else limit) + s.offset, lat, lon)
            extra, order = ["dist"], [F.col("dist")]
        if s.order:
            order = [F.col(f"`{keyed.resolve(rows, c)}`").desc() if down else F.col(f"`{keyed.resolve(rows, c)}`") for c, down in s.order]
        elif not order and t.kind in ("sequential", "isam", "btree") and t.key:
            c = F.col(f"`{t.key}`")
            order = [functions.number(c).asc_nulls_last(), c] if t.kind == "btree" else [c.cast("string")]
        rows = rows.orderBy(*order) if order else rows
        rows = rows.offset(s.offset) if s.offset else rows
        rows = rows.limit(limit) if limit is not None else rows
        shown = [c for c in t.rows.columns if c != "_doc_id"] if s.fields == ["*"] else s.fields
        named = keyed.project(rows.withColumns(self._pseudo(t, rows)), [c for c in shown if c not in extra])
        return keyed.project(rows.withColumns(self._pseudo(t, rows)), [*named.columns, *extra])

    def _pseudo(self, t: Table, rows: DataFrame) -> dict:
        if t.kind != "media":
            return {}
        path = F.col(f"`{t.id_col}`")
        return {n: c for n, c in (("filename", functions.basename(path)), ("file_path", path)) if n not in rows.columns}

    def _media(self, t: Table, w: P.MediaMatch, k: int) -> DataFrame:
        if t.kind != "media":
            raise ValueError(f"{t.name} is no media table")
        known = t.index.vectors.filter((F.col("id") == w.file) | (functions.basename(F.col("id")) == w.file.rsplit("/", 1)[-1]))
        item = known.orderBy((F.col("id") == w.file).desc(), "id").select("id").first()
        if item is not None:
            found = media.knn(t.index, item_id=item["id"], k=k, method=w.method)
        else:
            found = media.knn(t.index, feature=features.of_file(w.file, t.key), k=k, method=w.method)
        found = found.withColumn("similarity", F.round("similarity", 4)).withColumnRenamed("id", "path")
        return media.with_metadata(found, t.rows, t.id_col).withColumn(t.id_col, F.col("path"))

    def _added(self, t: Table, new: DataFrame) -> None:
        """Append rows as files of their own."""
        part = keyed.stored(new, t.kind, t.key, arrange=False)
        self._changed(t, t.stored.unionByName(part))

    def _changed(self, t: Table, stored: DataFrame, most: int = 32) -> None:
        changed = self._put(self._with(t, stored, t.changes + 1))
        if changed.changes >= most:
            self.compact(t.name)

    def _writable(self, name: str) -> Table:
        t = self.table(name)
        if t.kind in ("text", "media", "embedding"):
            raise ValueError(f"{t.name} is a {t.kind} table; rows change by building it anew")
        return t

    def _insert(self, s: P.Insert) -> DataFrame:
        t = self._writable(s.table)
        new = keyed.insert(t.rows.limit(0), s.rows).coalesce(1)
        if t.kind == "rtree" and spatial.places(new, *t.key.split(",")).count() < len(s.rows):
            raise ValueError("a row has no place on the globe")
        self._added(t, new)
        return self.spark.createDataFrame([(len(s.rows),)], "inserted long")

    def _insertseries(self, s: P.InsertSeries) -> DataFrame:
        t = self._writable(s.table)
        first, *rest = t.rows.dtypes
        new = self.spark.range(s.low, s.high + 1).select(F.col("id").cast(first[1]).alias(first[0]), *[F.lit(None).cast(k).alias(c) for c, k in rest])
        self._added(t, new)
        return self.spark.createDataFrame([(max(0, s.high - s.low + 1),)], "inserted long")

    def _delete(self, s: P.Delete) -> DataFrame:
        t = self._writable(s.table)
        near = keyed.narrowed(t.stored, t.key_column, s.column, s.value)
        removed = stage(keyed.delete(near, s.column, s.value, t.kind)[1].select(*[F.col(f"`{c}`") for c in t.rows.columns]), "removed")
        self._changed(t, keyed.delete(t.stored, s.column, s.value, t.kind)[0])  # rows stay in their files and are left out of scans
        return removed

    def _showtables(self, s: P.ShowTables) -> DataFrame:
        return self.show_tables(s.like)

    def _describe(self, s: P.Describe) -> DataFrame:
        return self.describe(s.table)

    def _showindex(self, s: P.ShowIndex) -> DataFrame:
        rows = [(t.name, t.kind, t.key) for t in self.tables.values() if s.table is None or t.name.lower() == s.table.lower()]
        return self.spark.createDataFrame(rows, "table string, kind string, key string")

    def _droptable(self, s: P.DropTable) -> DataFrame:
        t = self.table(s.table)
        del self.tables[t.name]
        self.spark.catalog.dropTempView(t.name)
        return self.show_tables()
