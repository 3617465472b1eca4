"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: What belongs to an application, whichever of its session objects asks: the temporary folder of a single machine, the package sent out.
_folders: dict[str, str] = {}
_shipped: set[str] = set()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package to Python workers that cannot already find it.

    Workers see it when the repository is their working folder or on PYTHONPATH;
    otherwise one archive of the package goes out through Spark's file server, once an application.
    """
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if os.getcwd() == str(ROOT) or str(ROOT) in paths or spark.sparkContext.applicationId in _shipped:
        return
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))
    target = Path(tempfile.mkdtemp()) / "tallyspark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "tallyspark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir; where that is unset a temporary one, on a single machine (tests, bench) only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
            spark.sparkContext.setCheckpointDir(_folders[app])
        where = _folders[app]
    return where


def _run(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tallyspark-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage where a result is used more than once; the committed files
    outlive any executor, so a later loss replays only from here. They stay until ``unstage`` or ``clear_stages``.
    """
    path = f"{_run(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tallyspark_path = path
    return back


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again, such as the last round of an iteration; other DataFrames are left alone."""
    if path := getattr(df, "_tallyspark_path", None):
        _delete(spark, path)


def clear_stages(spark: SparkSession) -> None:
    """Deletes all that this application has staged; for when its results have been written."""
    _delete(spark, _run(spark))
