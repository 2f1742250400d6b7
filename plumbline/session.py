"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders of running jobs, and of local sessions without a setting, by application.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own, because no
    executor on another machine could read it.
    """
    own = _OWN.get(spark.sparkContext.applicationId)
    if own:
        return own
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def materialize(df: DataFrame, label: str, *, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files, and every later
    branch sees the same rows in the same partitions' columns. ``compression`` replaces the
    session's codec for Parquet.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """``materialize`` with the rows in ``parts`` buckets by ``key``, which Spark knows when it
    reads them: joins, groups and windows on ``key`` need no shuffle. ``forget`` drops the
    name that the session keeps of it."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def forget(spark: SparkSession, label: str) -> None:
    """Drop the names of dealt intermediates; their files stay with the scratch folder."""
    for t in spark.catalog.listTables(pattern=f"{label}_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediates of one job, deleted when the job is over.

    Frames made inside must be read to the end inside.
    """
    root, app = scratch_root(spark), spark.sparkContext.applicationId
    before = _OWN.get(app)
    _OWN[app] = own = f"{root}/job-{uuid.uuid4().hex}"
    try:
        yield own
    finally:
        _OWN.pop(app)
        if before:
            _OWN[app] = before
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
