"""File systems by path, on the driver and in tasks."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; a path without a scheme is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
