"""Folders that the whole cluster shares, and files in them as tasks see them."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the cluster's default file system where it has none."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toString()
    return "file:///" + out[5:].lstrip("/") if out.startswith("file:") else out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; removed when the driver ends.

    Without that setting a local session gets a folder of its own; on a cluster that is
    an error, as executors would not share it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif context.master.split("[")[0] == "local":
            root = f"file://{tempfile.mkdtemp(prefix='scribeflow-')}"
            context.setCheckpointDir(root)
        else:
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
    path = f"{qualified(spark, root)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the context may be gone; the folder is only scratch
            continue


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without scheme is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def listed(uri: str, ending: str = "") -> list[tuple[str, int]]:
    """(URI, bytes) of all files below a folder, or of the file itself, in order of their names.

    Names that begin with an underscore or a dot, and what lies below them, are left out.
    """
    fs, path = opened(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"
    one = fs.get_file_info(path)
    infos = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    out = []
    for info in infos:
        below = info.path[len(path) :] if info is not one else posixpath.basename(info.path)
        if info.type == pafs.FileType.File and info.path.lower().endswith(ending) and not any(x[:1] in "_." for x in below.split("/") if x):
            out.append((head + info.path, info.size))
    return sorted(out)
