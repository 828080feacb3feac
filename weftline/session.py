"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own_dir: str | None = None
_written: list[Written] = []


def build_session(app: str = "weftline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for; anything already set on the cluster stays."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_values(df: DataFrame, column: str, most: int = 1_000) -> list:
    """The distinct values of a small fixed table's column, in order; an error if there are more than `most`."""
    rows = df.select(column).where(f"`{column}` is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column}: more than {most} values are no fixed table")
    return sorted(r[0] for r in rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and all run in one process, as in tests."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


class Written:
    """A table written to the shared folder: it cuts lineage, survives lost executors and can be dropped when used up.

    Aggregates given as `measures` are taken while it is written and are in `seen`, by name: no second pass over the table.
    """

    def __init__(self, df: DataFrame, **measures: Column):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
        watch = Observation() if measures else None
        (df.observe(watch, *[c.alias(n) for n, c in measures.items()]) if watch else df).write.parquet(self.path)
        self.seen = watch.get if watch else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _written.append(self)

    def drop(self) -> None:
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in _written:
            _written.remove(self)


def drop_written() -> None:
    """Delete every table of this process that is still in the shared folder; for when the results made of them are stored."""
    for one in list(_written):
        one.drop()
