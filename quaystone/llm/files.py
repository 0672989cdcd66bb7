"""Binary files in the shared folder, written and read inside tasks.

A task writes each file under a name of its own and reports it in a row; rows reach a manifest table only from tasks that
succeeded. A task that runs again writes another file, and nothing refers to the first.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs, ...), and the path in it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def unique(stem: str, task: int) -> str:
    return f"{stem}-{task:06d}-{uuid.uuid4().hex[:12]}"


class Reader:
    """Byte ranges of one file: memory-mapped where it is local, else by range reads."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.map = self.file = None
        if isinstance(system, fs.LocalFileSystem):
            self.map = np.memmap(name, np.uint8, "r") if system.get_file_info(name).size else np.zeros(0, np.uint8)
        else:
            self.file = system.open_input_file(name)

    def read(self, at: int, length: int) -> np.ndarray:
        if self.map is not None:
            return self.map[at : at + length]
        return np.frombuffer(self.file.read_at(length, at), np.uint8)

    def close(self) -> None:
        self.map = None
        if self.file is not None:
            self.file.close()
