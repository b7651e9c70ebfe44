"""Session helpers: local sessions for tests, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "siltstone") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where nothing is set (a local test session) a temporary folder is made and set.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Steps that are materialized within are removed at the end; for work whose results are read, written or collected by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back.

    The files survive lost executors and hold no lineage, so later steps that read the
    result several times compute it once. Within `scratch` they are removed at its end; else they stay
    as long as the folder, since a result that isn't read yet may need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `most` rows of a few short columns; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written once per application to the shared folder and read by all who ask for the same key.

    Made anew if its files are gone.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key in _kept:
        files = _kept[key].inputFiles()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]) if files else None
        if path is not None and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return _kept[key]
    _kept[key] = materialize(make(), str(key[1]))
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
