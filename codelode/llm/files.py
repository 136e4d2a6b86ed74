"""Files in the shared folder, written and read by tasks, and arrays mapped into a worker's memory."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_mapped: dict[str, np.ndarray] = {}


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def publish(uri: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it into place: readers never see a part of it, and a task that runs twice is harmless."""
    store, path = at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part", compression=None) as out:
        out.write(data)
    store.move(part, path)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a published file, memory-mapped: workers of a machine share its pages. A file of a remote store is first copied to the worker's own disk."""
    if uri not in _mapped:
        store, path = at(uri)
        if not isinstance(store, fs.LocalFileSystem):
            with store.open_input_stream(path, compression=None) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                while block := source.read(1 << 20):
                    copy.write(block)
            path = copy.name
        _mapped.clear()
        _mapped[uri] = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        if not isinstance(store, fs.LocalFileSystem):
            os.unlink(path)  # the mapping keeps it
    return _mapped[uri]
