"""Session helpers shared by all operators: durable intermediate tables and worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a local master gets a
    temporary folder (there is one machine then) and a cluster uses its warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local"):
            path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weftgraph"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This cuts the lineage for good: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and aggregates of the rows, taken while they are written: no second job reads the table."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), name)
    return out, seen.get


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftgraph-ship-"), "weftgraph_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("weftgraph", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
