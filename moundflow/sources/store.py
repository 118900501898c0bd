"""Files of any store, opened in Python tasks (Spark's own readers do not need this)."""
from __future__ import annotations


def open_store(path: str):
    """The pyarrow file system of a path or URI and the name there."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
