"""Files of our own formats in the shared folder, written and read by tasks.

Spark has no writer for raw bytes, so tasks open these files through pyarrow.fs, which knows local and
shared mounts, HDFS and object stores by their URI. A task writes under a name that no other attempt
uses and reports it; only files that the written manifest names are ever read, so a lost executor or a
repeated task leaves nothing half-done in sight.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def fresh_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    where, path = _opened(uri)
    if isinstance(where, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return where.open_output_stream(path, compression=None)


def reader(uri: str):
    """A stream of a file's bytes, uncompressed or not as they lie."""
    where, path = _opened(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def seekable(uri: str):
    where, path = _opened(uri)
    return where.open_input_file(path)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes, memory-mapped. From a store that can't be mapped it is copied first, to a local file without a name."""
    where, path = _opened(uri)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as local:
        with where.open_input_stream(path, compression=None) as source:
            shutil.copyfileobj(source, local, 1 << 20)
        local.flush()
        return np.memmap(local.name, np.uint8, "r")
