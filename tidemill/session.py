"""Session factory and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemill")
    settings = _DEFAULTS | {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, whose single JVM shares this machine's disk with itself, is a
    folder made where the session names none; on a cluster that is an error, as each
    executor would write to its own disk and read a part of what was written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: intermediate tables need a folder that all executors of {master} share")
        base = _own_dirs.setdefault(app, "")
        if not base:
            base = _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return f"{base.rstrip('/')}/tidemill-{app}"


_to_clear: set[str] = set()
_scopes: list[list[tuple[str, str | None]]] = []


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear() -> None:
    active = SparkSession.getActiveSession()
    if active is None:
        return
    try:
        for place in _to_clear:
            _delete(active, place)
    except Exception:  # the session may be gone already
        pass


atexit.register(_clear)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end: put a query and the use of its result inside.

    Outside of any scope they stay until the driver exits, as a result not yet read may need them.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for place, name in _scopes.pop():
            if name is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(spark, place)


def _place(spark: SparkSession, name: str, table_name: str | None = None) -> str:
    root = shared_dir(spark)
    _to_clear.add(root)
    place = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append((place, table_name))
    return place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage with replicated files, so that a lost executor costs only its
    running tasks.
    """
    spark = df.sparkSession
    place = _place(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def bucketed(df: DataFrame, name: str, by: str, buckets: int, parts: str | None = None) -> DataFrame:
    """The same as a table bucketed by ``by`` (and cut into folders by ``parts``): joins and aggregations by that column need no exchange.

    Rows are laid out once, a file a bucket and folder. The table is known to the session only.
    """
    spark = df.sparkSession
    table_name = f"tidemill_{re.sub('[^0-9a-z]', '_', name)}_{uuid.uuid4().hex[:12]}"
    place = _place(spark, name, table_name)
    writer = df.repartition(buckets, by).write.format("parquet").option("path", place).bucketBy(buckets, by).sortBy(by)
    (writer.partitionBy(parts) if parts else writer).saveAsTable(table_name)
    return spark.table(table_name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table: one parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
