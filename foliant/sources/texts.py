"""Texts as files: each row of (name, text) one file, written by the task that has it; and what of a folder is no longer wanted."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITTEN = "name string, n_bytes long, sha256 string"


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            content, target = (text or "").encode(), f"{root}/{name}"
            parent, _, last = target.rpartition("/")
            store.create_dir(parent, recursive=True)
            draft = f"{parent}/.{last}.{uuid.uuid4().hex}"  # readers see the old file or the new one, whole
            with store.open_output_stream(draft, compression=None) as out:
                out.write(content)
            store.move(draft, target)
            rows.append((name, len(content), hashlib.sha256(content).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], ["name", "n_bytes", "sha256"])


def write_texts(files: DataFrame, folder: str) -> DataFrame:
    """The files (name, text) below a folder, and (name, n_bytes, sha256) of each, computed when the result is read.

    A name may have folders in it. A file that is there is replaced by one
    move; a repeated attempt writes the same again. Names must differ: of two
    rows with one name either stays. A null text is an empty file; a null
    name is refused.
    """
    named = files.select(F.coalesce("name", F.raise_error(F.lit("a file without a name")).cast("string")).alias("name"), "text")
    return named.mapInArrow(lambda it: _write(folder, it), WRITTEN)


def _list(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for first in batch.column("name").to_pylist():
            found = store.get_file_info(fs.FileSelector(f"{root}/{first}", allow_not_found=True, recursive=True))
            names = [f.path[len(root) + 1 :] for f in found if f.type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files below a folder, relative to it, empty ones too and drafts not; of no folder, none. Each folder right below it is listed by a task."""
    store, root = fs.FileSystem.from_uri(folder)
    first = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    folders = spark.createDataFrame([(f.base_name,) for f in first if f.type == fs.FileType.Directory], "name string")
    files = spark.createDataFrame([(f.base_name,) for f in first if f.type == fs.FileType.File], "name string")
    return files.unionByName(folders.mapInArrow(lambda it: _list(folder, it), "name string")).filter(~F.col("name").rlike("(^|/)\\.[^/]*$"))


def _delete(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            try:
                store.delete_file(f"{root}/{name}")
            except FileNotFoundError:  # a repeated attempt
                pass
        yield batch


def prune_texts(expected: DataFrame, folder: str, pattern: str = ".*") -> DataFrame:
    """Deletes the files below a folder that match the pattern and are not expected (name), and gives their names, when the result is read."""
    gone = listed(expected.sparkSession, folder).filter(F.col("name").rlike(f"^(?:{pattern})$")).join(expected.select("name"), "name", "left_anti")
    return gone.mapInArrow(lambda it: _delete(folder, it), "name string")
