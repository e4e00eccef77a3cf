import pytest
from pyspark.sql import functions as F

from quillon import sources, streaming
from quillon.operators import dataprep
from quillon.plans import parser as P
from quillon.plans.session import Session

from .conftest import rows


def test_statements():
    s = P.parse("SELECT a, b FROM t WHERE x = 'o''k' AND n BETWEEN 1 AND 2.5 ORDER BY a DESC, b LIMIT 3 OFFSET 4;")
    assert (s.fields, s.limit, s.offset, s.order) == (["a", "b"], 3, 4, [("a", True), ("b", False)])
    assert s.where == [P.Compare("x", "=", "o'k"), P.Compare("n", "between", 1, 2.5)]
    assert P.parse('select * from m where p <-> "a b.jpg" method Sequential limit 2').where == [P.MediaMatch("p", "a b.jpg", "sequential")]
    assert P.parse("SELECT * FROM g WHERE loc <-> '(1.5, -2)' < 30").where == [P.Near("loc", 1.5, -2.0, 30.0)]
    assert P.parse("SELECT * FROM g ORDER BY loc <-> '(1, 2)' LIMIT 5").near == P.Near("loc", 1.0, 2.0)
    assert P.parse('CREATE TABLE t FROM FILE "a.csv" USING INDEX spimi("x", "y")') == P.CreateTable("t", "a.csv", "spimi", ["x", "y"])
    assert P.parse("CREATE TABLE t FROM FILE 'a.csv' USING INDEX rtree").columns == []
    assert P.parse("CREATE MULTIMEDIA TABLE t FROM FILE 'a.csv' USING audio WITH METHOD mfcc CLUSTERS 9") == P.CreateMedia("t", "a.csv", "audio", "mfcc", 9)
    assert P.parse("INSERT INTO t VALUES (1, 'a)b', )").rows == [[1, "a)b", None]]
    assert P.parse("DELETE FROM t WHERE c = 'v'") == P.Delete("t", "c", "v")
    assert isinstance(P.parse("SELECT count(*) FROM t"), P.Plain) and isinstance(P.parse("WITH x AS (SELECT 1) SELECT * FROM x"), P.Plain)
    for bad in ("SELECT * FROM t WHERE c @@ 'x' nonsense", "DELETE FROM t", "CREATE TABLE t FROM FILE 'a' USING INDEX"):
        with pytest.raises(P.SyntaxProblem):
            P.parse(bad)


def test_keyed_tables_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n10,"b, c",x\n9,a,\n10,"q ""z""","two\nlines"\n', encoding="latin1")
    s = Session(spark)
    s.sql(f'CREATE TABLE t FROM FILE "{tmp_path}/a.csv" USING INDEX btree("id")')
    assert [r.id for r in s.sql("SELECT * FROM t").collect()] == ["9", "10", "10"]
    assert rows(s.sql("SELECT name FROM t WHERE id = 10")) == [("b, c",), ('q "z"',)]
    assert s.sql("SELECT note FROM t WHERE id = '9'").first().note == ""
    s.sql("INSERT INTO t VALUES (11, 'new', NULL)")
    assert rows(s.sql("DELETE FROM T WHERE name = 'a'")) == [("9", "a", "")]
    assert [r.id for r in s.sql("SELECT id FROM t WHERE id BETWEEN 10 AND 20").collect()] == ["10", "10", "11"]
    s.sql("INSERT INTO t SELECT generate_series(50, 52)")
    assert s.info("t")["rows"] == 6
    assert s.sql("SHOW TABLES LIKE 'T'").count() == 1 and s.sql("DESCRIBE t").count() == 3 and s.sql("SHOW INDEX FROM t").first().kind == "btree"
    assert s.sql("SELECT count(*) AS n FROM t").first().n == 6
    s.save(str(tmp_path / "w"))
    assert Session.load(spark, str(tmp_path / "w")).info("t")["rows"] == 6
    s.sql("DROP TABLE t")
    with pytest.raises(ValueError):
        s.table("t")


def test_text_media_and_places(spark, tmp_path):
    (tmp_path / "songs.csv").write_text("track,lyrics\none,red moon\ntwo,blue sun\nthree,red sun\n")
    s = Session(spark)
    s.sql(f"CREATE TABLE songs FROM FILE '{tmp_path}/songs.csv' USING INDEX inverted(lyrics, absent)")
    got = s.sql('SELECT track, missing FROM songs WHERE lyrics @@ "moon" LIMIT 5').collect()
    assert [(r.track, r.missing) for r in got] == [("one", "")] and got[0].similarity_score > 0
    with pytest.raises(ValueError):
        s.sql("DELETE FROM songs WHERE track = 'one'")
    vectors = [(f"img/{k}.jpg", [float(k == j) + 0.1 * j for j in range(4)]) for k in range(4)]
    s.register_media("pics", spark.createDataFrame(vectors, "image_path string, v array<double>"), "v")
    best = s.sql('SELECT filename FROM pics WHERE v <-> "2.jpg" LIMIT 2').collect()
    assert best[0].filename == "2.jpg" and best[0].similarity == 1.0 and [r["rank"] for r in best] == [1, 2]
    s.register("shops", spark.createDataFrame([("a", "0", "179.9"), ("b", "0", "-179.9"), ("c", "95", "0")], "name string, lat string, lon string"), "rtree")
    assert [r.name for r in s.sql("SELECT name FROM shops WHERE place <-> '(0, 179.95)' < 30").collect()] == ["a", "b"]
    assert [r.name for r in s.sql("SELECT name FROM shops ORDER BY place <-> '(0, -179.9)' LIMIT 1").collect()] == ["b"]
    with pytest.raises(ValueError):
        s.sql("INSERT INTO shops VALUES ('d', 99, 0)")
    s.save(str(tmp_path / "all"))
    again = Session.load(spark, str(tmp_path / "all"))
    assert [r.track for r in again.sql('SELECT track FROM songs WHERE lyrics @@ "moon"').collect()] == ["one"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string")
    sources.write_csv(df, str(tmp_path / "c"))
    assert rows(sources.read_csv(spark, str(tmp_path / "c"))) == [("1", 'a "b", c'), ("2", "")]
    sources.write_json(df, str(tmp_path / "j"))
    assert sources.read_json(spark, str(tmp_path / "j")).count() == 2
    assert rows(df.select(sources.csv_line(F.col("id"), F.col("t")))) == [('1,"a ""b"", c"',), ("2,",)]
    (tmp_path / "f" / "000").mkdir(parents=True)
    (tmp_path / "f" / "000" / "x.mp3").write_bytes(b"12")
    assert [(r.name, r.subdirectory) for r in sources.read_files(spark, str(tmp_path / "f"), "*.mp3", content=False).collect()] == [("x.mp3", "000")]
    assert sources.from_rows(spark, [{"a": 1}, {"b": "x"}]).columns == ["a", "b"] and sources.from_rows(spark, [[1, "x"], [2]]).count() == 2
    assert sources.example_products(spark, 20).count() == 20 and sources.from_embeddings(spark, [[1, 2]], [{"m": 3}]).first().m == 3


def test_dataprep(spark):
    rows_ = spark.createDataFrame([("x/1.mp3",), ("y/2",), ("z/3.mp3",)], "p string")
    table = spark.createDataFrame([("x/1.mp3", 10), ("q/2.mp3", 20)], "path string, v int")
    assert rows(dataprep.looked_up(rows_, table, "p", "path", "v", ".mp3")) == [("x/1.mp3", 10), ("y/2", 20), ("z/3.mp3", None)]
    assert rows(dataprep.missing(rows_, table, "p", "path")) == [("y/2",), ("z/3.mp3",)]
    a, b = spark.createDataFrame([(k, k) for k in range(1, 7)], "id int, r int"), spark.createDataFrame([(k, k - 3) for k in range(4, 10)], "id int, r int")
    got = dataprep.overlap(a, b, "id", "r").first()
    assert (got.n_both, got.n_either, got.jaccard, got.overlap_at_5) == (3, 9, round(3 / 9, 6), 2)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red moon"), (2, "blue sun"), (3, None)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        arriving = streaming.read_stream(spark, str(tmp_path / "in"), docs.schema)
        streaming.ingest(arriving, "doc_id", ["text"], str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination()
    from quillon.operators import text

    assert text.search(streaming.index_of(spark, str(tmp_path / "counts"), ["text"]), "moon").first().doc_id == 1


def test_scripts(spark, capsys):
    from quillon.__main__ import main, statements

    assert statements("-- note\nSELECT 1; SELECT ';' AS a;\n") == ["SELECT 1", "SELECT ';' AS a"]
    assert main(["-e", "SHOW TABLES; SELECT 1 AS one; SELECT * FROM nowhere"]) == 1
    assert "one" in capsys.readouterr().out
