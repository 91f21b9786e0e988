"""Stores that hold trees of files: what mounts them, or an object store or HDFS by Arrow's client. Names may start with anything."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

# Path components that are never entered.
EXCLUDED = ("node_modules", "target", ".git", "dist", "build", ".scs", "__pycache__", "vendor", ".next", ".nuxt", "coverage", ".venv", "venv")
#: An index's own folder is not entered either.
OWN = ".loom"


class Mounted:
    """A tree that every node mounts. Paths are bytes, as names need not be UTF-8."""

    def __init__(self, root: str):
        path = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
        self.base = os.fsencode(os.path.abspath(path))

    def entries(self, folder: bytes) -> Iterator[tuple[bytes, bool, int, int]]:
        """(path, is a folder, seconds of its time, length); a link to a folder is neither folder nor file."""
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.path, True, 0, 0
                    continue
                try:
                    s = e.stat()
                except OSError:  # a link to nothing, or gone meanwhile
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield e.path, False, int(s.st_mtime), s.st_size

    def read(self, path: bytes) -> bytes:
        with open(path, "rb") as f:
            return f.read()


class Remote:
    """A tree in a store that Arrow has a client for: s3, gs, abfs, and hdfs or viewfs where nodes have libhdfs."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(root)
        self.base = base.rstrip("/").encode()

    def entries(self, folder: bytes) -> Iterator[tuple[bytes, bool, int, int]]:
        from pyarrow import fs

        for e in self.fs.get_file_info(fs.FileSelector(folder.decode())):
            if e.type == fs.FileType.Directory:
                yield e.path.encode(), True, 0, 0
            elif e.type == fs.FileType.File:
                yield e.path.encode(), False, (e.mtime_ns or 0) // 1_000_000_000, e.size

    def read(self, path: bytes) -> bytes:
        with self.fs.open_input_file(path.decode()) as f:
            return f.readall()


def store(root: str) -> Mounted | Remote:
    scheme = root.partition("://")[0] if "://" in root else ""
    return Remote(root) if scheme not in ("", "file") else Mounted(root)


def entered(path: bytes) -> bool:
    """Whether a folder, or a file of this name, is looked at."""
    return os.fsdecode(path.rpartition(b"/")[2]) not in (*EXCLUDED, OWN)
