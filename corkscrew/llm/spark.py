"""Session helpers of this subpackage: folders, Arrow batches, worker state."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from corkscrew.session import scratch_path

#: Text per vectorised step; bounds a worker's memory whatever the batch holds.
STEP_BYTES = 2 << 20


def ship(package: str = "corkscrew.llm") -> None:
    """Send functions of this subpackage to executors by value, so that a
    cluster without the package on its Python path runs them too."""
    module = sys.modules[package]
    if package not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(module)


def tune(spark: SparkSession) -> None:
    """Batches of bounded size (a scan of 4,096 texts at once, the default,
    holds tens of MB a column), and shuffle files dropped once the statement
    that made them has ended (results go to written tables)."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def relax(spark: SparkSession) -> None:
    """Keep shuffle files again: other queries of the session may reuse theirs."""
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def settle(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and frees the shuffle files behind it.
    ``rows_per_file``: for large rows, which readers and writers gather by file
    (0: no limit)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables of ``settle`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker."""
    holder = sys.modules.setdefault("_corkscrew_worker", types.ModuleType("_corkscrew_worker"))
    return holder.__dict__.setdefault(name, {})
