"""Session, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "graphloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def importable_on_workers(spark: SparkSession) -> None:
    """Put this package's folder on the workers' path, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    importable_on_workers(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Unset is allowed only with a local master (tests); a machine-local temporary
    folder is then made and removed when the process ends.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


_local: str | None = None


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path on the driver's JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, deleted when the driver's JVM ends.

    A result may be read until then, as long as the session that made it lives;
    what a killed driver leaves behind can go once its application is over.
    """
    folder = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}-{os.getpid()}"
    if folder not in _runs:
        files, place = _files(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _runs.add(folder)
    return folder


_runs: set[str] = set()


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar and compressed, so
    that later stages prune columns and a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    return out


def drop_materialized(df: DataFrame | None) -> None:
    """Delete the files behind a frame made by :func:`materialize`, once nothing reads them any more."""
    path = getattr(df, "materialized_path", None)
    if path is not None:
        files, place = _files(df.sparkSession, path)
        files.delete(place, True)
