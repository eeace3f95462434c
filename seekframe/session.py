"""Ships this package to the executors, which may have neither the driver's folder nor its Python path."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the executors' Python path, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="seekframe-")) / "seekframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package on the executors; its first argument is the session."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine, as in tests, may it be unset: then a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seekframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; its lineage ends with the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As shared(), but as Parquet: later reads take only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run in it, Python workers get one row at a time, for rows that are whole shards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, was)
