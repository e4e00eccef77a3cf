"""Session settings and materialisation shared by all operators.

Intermediate results that are read more than once are written as Parquet below
the folder named by ``spark.checkpoint.dir`` (a folder every executor shares),
so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_staged: list[tuple[Any, str]] = []
_shipped: set[str] = set()


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, which need not have it installed; once a session."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="quillon-package-")) / "quillon.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``. Where that is unset, one of our own on a local master; a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def stage(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` below the shared folder and read it back; cuts lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released() -> Iterator[None]:
    """Delete, at the end of the block, all that was staged in it, so that a long session need not fill the shared folder."""
    before = {path for _, path in _staged}
    try:
        yield
    finally:
        release_all({path for _, path in _staged} - before)


def release_all(paths: set[str] | None = None) -> None:
    """Delete the staged tables at these paths, or every one, of sessions that are still alive."""
    gone = [x for x in _staged if paths is None or x[1] in paths]
    _staged[:] = [x for x in _staged if x not in gone]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            pass


atexit.register(release_all)


def bounded(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of at most about ``size`` bytes of a text column, so that long texts take no more memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
