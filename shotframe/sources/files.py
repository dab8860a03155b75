"""Bytes of files for data sources, whose readers run outside Spark's own file layer: local paths, and stores that Arrow opens by URI."""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """The local path of a plain path or file: URI, else None."""
    scheme = urlparse(path).scheme
    return unquote(urlparse(path).path) if scheme == "file" else path if len(scheme) < 2 else None


def listed(path: str) -> list[str]:
    """The files of a path: itself, a folder's (not those that begin with a dot or underscore), or a local glob's; in order of name."""
    local = local_path(path)
    if local is not None:
        found = [local] if os.path.isfile(local) else glob.glob(os.path.join(local, "*")) if os.path.isdir(local) else glob.glob(local)
        return sorted(x for x in found if os.path.isfile(x) and os.path.basename(x)[0] not in "._")
    store, at = arrow_fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else f"{urlparse(path).scheme}://"
    info = store.get_file_info(at)
    rows = [info] if info.type == arrow_fs.FileType.File else store.get_file_info(arrow_fs.FileSelector(at))
    return sorted(head + x.path for x in rows if x.type == arrow_fs.FileType.File and x.base_name[0] not in "._")


def opened(path: str):
    """A file that can be read and sought in."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb")  # noqa: SIM115
    store, at = arrow_fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def length(f) -> int:
    now, end = f.tell(), f.seek(0, 2)
    f.seek(now)
    return end if isinstance(end, int) else f.size()


def put(path: str, content: bytes) -> None:
    """Write a whole file under another name and rename it, so that a file of that name is always whole."""
    local = local_path(path)
    unfinished = f"{os.path.dirname(local or path)}/.{uuid.uuid4().hex}"
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(unfinished, "wb") as f:
            f.write(content)
        os.replace(unfinished, local)
        return
    store, at = arrow_fs.FileSystem.from_uri(path)
    unfinished = f"{os.path.dirname(at)}/{os.path.basename(unfinished)}"
    with store.open_output_stream(unfinished) as f:
        f.write(content)
    store.move(unfinished, at)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(rows, path: str) -> None:
    """Write (file, content) rows as files of a folder; a repeated task writes the same files again."""

    def run(parts):
        for part in parts:
            for name, content in zip(part["file"], part["content"], strict=True):
                put(f"{path}/{name}", bytes(content))
            yield part[["file"]]

    rows.select("file", "content").mapInPandas(run, "file string").write.format("noop").mode("overwrite").save()
