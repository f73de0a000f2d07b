"""Raw arrays in the shared folder, memory-mapped by the workers that read them."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(url: str) -> str | None:
    parts = urlparse(url)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its name; a retried task replaces the file by an equal one."""
    where = _local(folder)
    if where is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(np.ascontiguousarray(array).tobytes())
        return
    os.makedirs(where, exist_ok=True)
    part = f"{where}/.{name}-{uuid.uuid4().hex}"
    np.ascontiguousarray(array).tofile(part)
    os.replace(part, f"{where}/{name}")


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, mapped from the shared folder, or where that is not mounted from an unnamed local copy."""
    where = _local(folder)
    if where is not None:
        path = f"{where}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as source, tempfile.TemporaryFile() as copy:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.empty(0, dtype)
