"""Shared scratch space of the corpus operators, and files of their own formats in it."""

from __future__ import annotations

import os

from ..sources.shared import drop, new_path, shared_dir, shuffle_partitions, written

__all__ = ["drop", "filesystem", "new_path", "shared_dir", "shuffle_partitions", "written"]


def filesystem(path: str):
    """(file system, path in it) of a URI, for executors that write or read files of their own format."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
