"""Opening files by path or address, on the driver or in a task."""

from __future__ import annotations


def filesystem(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    import os

    return fs.LocalFileSystem(), os.path.abspath(uri)
