"""The folder shared by driver and executors, and files inside it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in local tests.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``, else a folder for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _LOCAL["dir"]


#: Folders made inside each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A URI below the shared folder that no earlier call returned."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return folder


@contextmanager
def scope() -> Iterator[list[str]]:
    """Folders that operators make inside are removed at its end.

    What is wanted of a result has to be written, or collected, before: a
    DataFrame that leaves the scope may read from a folder that is gone.
    """
    _SCOPES.append(made := [])
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for folder in made:
            drop(folder)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI; works on executors as on the driver."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write once to the shared folder and read back.

    Unlike a cached frame this survives the loss of any executor, and it keeps
    values that depend on the physical partition (ranks, partition ids) fixed.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(uri: str) -> None:
    """Remove a folder that an operator wrote and no longer needs."""
    system, path = filesystem(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
