"""Files written from tables: under temporary names, all or none, never over what is there."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.names import escapes

from .session import EditError


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    fs, path = open_fs(uri)
    return fs.get_file_info(path).type.name != "NotFound"


def publish_new(uri: str, data: bytes) -> None:
    """One file, whole, that isn't there yet."""
    if exists(uri):
        raise EditError(f"{uri} is there already")
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path.rsplit('/', 1)[0]}/.new-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, path)


def publish_files(files: DataFrame, uri: str) -> int:
    """Rows (path, content) as files below a folder that isn't there yet, written by the tasks; the folder gets its name at the end.

    A task that is tried again writes the same files again. Paths that leave the folder, or come twice, stop it before a byte is written.
    """
    if exists(uri):
        raise EditError(f"{uri} is there already")
    bad = files.where(escapes(F.col("path"))).select("path").first()
    if bad:
        raise EditError(f"{bad['path']} leaves the folder")
    twice = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise EditError(f"{twice['path']} comes twice")
    fs, path = open_fs(uri)
    parent, name = path.rsplit("/", 1)
    stage = f"{parent}/.new-{name}-{uuid.uuid4().hex}"
    root = uri[: len(uri) - len(path)] + stage if uri.endswith(path) else stage

    def run(batches):
        fs, base = open_fs(root)
        n = 0
        for batch in batches:
            for rel, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{base}/{rel}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                temp = f"{at}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(temp) as f:
                    f.write(body or b"")
                fs.move(temp, at)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    fs.create_dir(stage, recursive=True)
    try:
        n = files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        fs.move(stage, path)
    except BaseException:
        fs.delete_dir(stage)
        raise
    return n
