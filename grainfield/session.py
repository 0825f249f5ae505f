"""Session helpers: the shared folder, tables written to it, and a session builder for local work."""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests, a laptop) a folder of this process is made and set as the
    checkpoint folder; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        path = tempfile.mkdtemp(prefix="grainfield-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        _LOCAL[app] = path
    return _LOCAL[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `release` removes what was written there."""
    path = f"{shared_dir(spark)}/grainfield/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        atexit.register(_released, spark)
    _WRITTEN.setdefault(app, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    It cuts the lineage in a form that survives the loss of any executor, and gives the planner the
    table's true size, so that it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables this application wrote to the shared folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _released(spark: SparkSession) -> None:
    """At the end of the driver, as far as its session still runs."""
    with contextlib.suppress(Exception):
        release(spark)


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grainfield")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, from the shared folder, for functions that run there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    path = f"{shared_path(spark, 'package')}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
