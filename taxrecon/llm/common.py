"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import checkpointed as cut
from ..sources.storage import written

__all__ = ["claim", "cut", "fresh", "hash128", "importable", "partitions", "table", "written"]

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, free: Callable[[], None]) -> None:
    """For Python workers, which outlive their tasks: what other operators remember there is freed, so that
    the stages of a pipeline don't add up in memory."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    _held[owner] = free
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone keeps freed memory, and has a call to return it
            ctypes.CDLL(None).malloc_trim(0)


def importable(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once per session, unless their path has it already."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("taxrecon-" in x for x in sc._python_includes):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"taxrecon-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "taxrecon").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes from different seeds: at 10^11 keys one of them alone would collide."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7919), *cols)]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, so that extra columns of the caller never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
