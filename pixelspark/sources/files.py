"""Files wherever they are: by Arrow's file systems in Python workers, by Spark's own on the driver.

A path without a scheme is a local one for both. Readers of packet files run in workers and use Arrow (local, hdfs, s3, gs);
sinks write tables by Spark, so what they move, delete or write beside them goes through the same Hadoop file system.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

WILD = re.compile(r"[*?\[]")


def opened(path: str):
    """(Arrow file system, its path, the prefix that makes its paths whole again)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    # a URI's authority may belong to the system (hdfs) or to its paths (s3, gs)
    scheme, rest = path.split(":", 1)
    host = "" if scheme == "file" or rest.lstrip("/").startswith(inner.lstrip("/").split("/")[0]) else rest.lstrip("/").split("/")[0]
    return system, inner, f"{scheme}://{host}"


def listed(path: str, pattern: str = "*.tpx3") -> list[tuple[str, int, int]]:
    """(path, size, time of change in ns) of a file, a folder's files of the pattern, or a glob's, by name."""
    from pyarrow import fs

    if not path:
        return []
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)  # workers may stand elsewhere
    wild = WILD.search(path)
    if wild:
        base, pattern = path[: wild.start()].rpartition("/")[0] or ("/" if path.startswith("/") else "."), path
        system, inner, prefix = opened(base)
        pattern = pattern[len(base) :].lstrip("/")
        found = system.get_file_info(fs.FileSelector(inner, recursive="/" in pattern, allow_not_found=True))
        found = [f for f in found if f.is_file and f.path.count("/") - inner.rstrip("/").count("/") - 1 == pattern.count("/") and fnmatch.fnmatch(f.path[len(inner.rstrip("/")) + 1 :], pattern)]
    else:
        system, inner, prefix = opened(path)
        found = [system.get_file_info(inner)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted((prefix + f.path, f.size, f.mtime_ns or 0) for f in found if f.is_file)


def chunks(path: str, start: int, size: int, step: int) -> Iterator:
    """(offset, bytes) of a range of a file, step bytes at a time."""
    system, inner, _ = opened(path)
    with system.open_input_file(inner) as f:
        for at in range(start, start + size, step):
            yield at, f.read_at(min(step, start + size - at), at)


class Shared:
    """The driver's hands in Spark's file system at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self._path(path).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._path(path))) if self.exists(path) else []

    def bytes(self, path: str) -> int:
        return self.system.getContentSummary(self._path(path)).getLength()

    def folder(self, path: str) -> None:
        self.system.mkdirs(self._path(path))

    def replace(self, source: str, target: str) -> None:
        """Move to the target; what stood there is set aside first and deleted only when the move is done."""
        aside = f"{target}.replaced"
        self.delete(aside)
        parent = posixpath.dirname(target.rstrip("/"))
        if parent:
            self.folder(parent)
        old = self.exists(target)
        if old and not self.system.rename(self._path(target), self._path(aside)):
            raise OSError(f"{target} can't be set aside")
        if not self.system.rename(self._path(source), self._path(target)):
            if old:
                self.system.rename(self._path(aside), self._path(target))
            raise OSError(f"{source} can't be moved to {target}")
        self.delete(aside)

    def write(self, path: str, data: bytes | Iterator[bytes]) -> None:
        out = self.system.create(self._path(path), True)
        try:
            for part in [data] if isinstance(data, bytes) else data:
                for at in range(0, len(part), 1 << 20):
                    out.write(bytearray(part[at : at + (1 << 20)]))
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        f = self.system.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()


__all__ = ["Shared", "chunks", "listed", "opened"]
