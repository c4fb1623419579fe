"""Session and storage helpers that every operator may use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows in a batch for Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessel")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it.

    Rows go to Python in batches of BATCH_ROWS, unless the session names another number: texts are long, and both sides
    hold a batch whole.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(os.path.realpath(tempfile.mkdtemp())) / "tessel.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


_TWO_LEVEL = "spark.sql.codegen.aggregate.map.twolevel.enabled"


def one_map(spark: SparkSession) -> None:
    """From now on a hash aggregate has one map, not a small one before it, unless the session names this itself.

    Each map takes a whole page (32 MB on an executor of 3 GB) however few its keys are, in each task of each aggregate, so
    an executor's heap grows by tables of a few rows. Rows are the same either way.
    """
    if spark.conf.get(_TWO_LEVEL, None) is None:
        spark.conf.set(_TWO_LEVEL, "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{os.path.realpath(tempfile.gettempdir())}/tessel-shared"
    return named.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    path = getattr(df, "_tessel_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Up to so many 64-bit ids (16 bytes each in a hash relation) may be broadcast after they were counted.
BROADCAST_IDS = 1_000_000


def ids_side(ids: DataFrame) -> DataFrame:
    """A table of ids for a join: broadcast if its counted size is under BROADCAST_IDS, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids




def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
