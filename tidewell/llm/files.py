"""Files in the shared folder as tasks see them."""

from __future__ import annotations

import re

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file of the shared store (file:, hdfs:, s3:, gs:, or a plain path)."""
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[len("file:"):]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
