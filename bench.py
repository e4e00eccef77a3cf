"""Times of the headline queries, as one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the threads. Index builds are timed once; look-ups
are timed as the median of ``BENCH_RUNS`` over a built index, as the published numbers are.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from quillon import queries as Q
from quillon.operators import keyed, media, spatial, text
from quillon.runtime import build_session, table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
WORDS = ("love", "dance", "night", "heart", "rock", "party", "dream", "baby", "music", "feel")
CAPABILITIES = ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_mix", "p10_found")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def median(name: str, work: Callable[[], object]) -> None:
        work()
        times[name] = round(statistics.median(timed(work) for _ in range(RUNS)), 4)

    songs, docs, vectors, orders = (table(spark, SF, n) for n in ("spotify_songs", "documents", "embeddings", "orders"))
    run(songs.limit(1))
    built: list[text.TextIndex] = []
    text.build_index(docs, "doc_id", ["text"])  # code is compiled
    times["text_index_build_songs"] = round(timed(lambda: built.append(text.build_index(songs, "row_id", Q.SONG_FIELDS))), 4)
    index = built[0].cache()
    run(index.postings)
    run(index.frequencies)
    for word in WORDS:
        text.search(index, word, 10).collect()
    each = [statistics.median(timed(lambda w=w: text.search(index, w, 10).collect()) for _ in range(RUNS)) for w in WORDS]
    times["text_top10_mean_of_10_words"] = round(statistics.mean(each), 4)
    asked = spark.createDataFrame([(k, WORDS[k % 10]) for k in range(1000)], "query_id int, query string")
    median("text_top10_1000_queries_at_once", lambda: run(text.search_many(index, asked, 10)))

    media_index: list[media.MediaIndex] = []
    times["media_index_build"] = round(timed(lambda: media_index.append(media.build_index(vectors, "vec_id", "embedding"))), 4)
    m = media_index[0]
    m.vectors.persist(), m.postings.persist()
    median("knn_sequential", lambda: media.knn(m, item_id=7, k=8, method="sequential").collect())
    median("knn_inverted", lambda: media.knn(m, item_id=7, k=8, method="inverted").collect())
    places = Q._places(spark, SF)
    median("spatial_radius", lambda: spatial.radius(places, *Q.HERE, 2500.0).collect())
    median("spatial_knn", lambda: spatial.nearest(places, *Q.HERE, 15).collect())
    median("equality", lambda: keyed.equal(orders, "o_orderkey", 42).collect())
    median("range", lambda: run(keyed.in_range(orders, "btree", "o_totalprice", 1000, 50000)))

    try:
        from quillon.llm import queries as L

        known = Q.queries() | L.queries()
    except ImportError:
        known = Q.queries()
    for name in CAPABILITIES:
        if name in known:
            times[name] = round(timed(lambda f=known[name]: run(f(spark, SF))), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
