"""Where streaming jobs keep checkpoints and outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder the cluster names.

    Only a local session without that setting, as in tests, gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagetide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered_below(spark: SparkSession, folder: str, number: int, name: str = "batch") -> list[int]:
    """Numbers of the finished tables `folder/name=<number>` below a number, ascending."""
    at, files = _file_system(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at)]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(k for k in (int(n.split("=")[1]) for n in done if n.startswith(f"{name}=")) if k < number)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results."""
    at, files = _file_system(spark, folder)
    files.delete(at, True)
