"""Session settings and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def session(app: str = "corpusloom", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only where it is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-corpusloom-")
    return _OWN[app]


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``release`` deletes like a table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        atexit.register(_at_end, spark, app)
    _MADE.setdefault(app, []).append(path)
    return path


def _at_end(spark: SparkSession, app: str) -> None:
    """Delete what an application has left, if its session still runs when the program ends."""
    jsc = spark.sparkContext._jsc
    if jsc is not None and spark.sparkContext.applicationId == app:
        release(spark)


def materialize(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with columnar, compressed files that any executor can read again after a
    loss. Ids, counts and signatures go this way, texts only between stages of the pipeline and in
    samples of a stated size.
    """
    path = folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> int:
    """How many tables this application has materialized and not released."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables materialized after the first ``since``, but for the last ``keep``; no result may need them any more."""
    own = _MADE.get(spark.sparkContext.applicationId, [])
    paths = own[since : len(own) - keep]
    del own[since : len(own) - keep]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    return len(paths)
