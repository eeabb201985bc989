"""Sessions, table loading and lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sieveline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application.

    On a cluster the archive lies in the shared folder of spark.checkpoint.dir; where none is named, the package
    must be installed on the executors. A temporary folder is used only where driver and executors are one.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    if sc.master.startswith("local["):
        path = os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline_pkg.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
    elif shared := spark.conf.get("spark.checkpoint.dir", ""):
        path = f"{shared}/sieveline-{sc.applicationId}/sieveline_pkg.zip"
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(data.getvalue()))
        out.close()
    else:
        return
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that the cluster names.

    spark.checkpoint.dir is read from the session; a local folder is set only where that and the
    context's own setting are absent, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="sieveline-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 100_000) -> DataFrame:
    """Joins with a broadcast when a count shows that the small side has at most max_rows rows.

    Beyond that the join is left to a shuffle with AQE's skew handling.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
