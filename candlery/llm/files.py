"""Files that executors write to and read from the shared folder, on any file system that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; path is a URI (file, hdfs, s3, gs) or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def make_folder(path: str) -> None:
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)
