"""Session defaults for tests, the bench and interactive use (a cluster brings its own), and what every session needs."""

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.abspath(__file__))
ARCHIVE = "factloom-package.zip"


def local_session(cores: str = "8", partitions: int = 8, app: str = "factloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per session, so that they can import it wherever the driver runs."""
    context = spark.sparkContext
    if not any(str(f).endswith(ARCHIVE) for f in context.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="spark-factloom-package-"), ARCHIVE)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("factloom", os.path.relpath(full, PACKAGE)))
        context.addPyFile(path)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark's Parquet reader sees it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder in spark.checkpoint.dir: its plan ends there, and a lost executor costs no recomputation.
    Only in local mode, where that may be unset, a folder of our own serves."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-factloom-"))
    return df.checkpoint()


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: exploding an array of one keeps the optimizer from working it out again for
    each use, and filters above it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
