"""Raw arrays and Arrow files in the shared store: written once under their final name, memory-mapped where the store is mounted."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a URI in a mounted file system, or None."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def new_file(uri: str):
    """A binary file that appears under its name only when whole, so that a task that runs twice does no harm."""
    aside = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(aside), "wb") as f:
            yield f
        os.replace(local_path(aside), path)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(aside)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(at) as f:
            yield f
        store.move(at, fs.FileSystem.from_uri(uri)[1])


def put_array(uri: str, values: np.ndarray) -> None:
    with new_file(uri) as f:
        f.write(memoryview(np.ascontiguousarray(values)).cast("B"))


def get_array(uri: str, dtype) -> np.ndarray:
    """Memory-mapped; a store that is not mounted is read instead."""
    if (path := local_path(uri)) is not None:
        # a plain view: numpy's own class costs microseconds for each index
        return np.asarray(np.memmap(path, dtype=dtype, mode="r")) if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def put_arrays(uri: str, arrays: dict[str, np.ndarray], types: dict[str, type]) -> None:
    """Arrays of the given types in one file, behind their lengths; the largest items first, so that each is aligned."""
    names = sorted(types, key=lambda x: -np.dtype(types[x]).itemsize)
    with new_file(uri) as f:
        f.write(np.array([len(arrays[x]) for x in names], dtype=np.int64).tobytes())
        for x in names:
            f.write(memoryview(np.ascontiguousarray(arrays[x], dtype=types[x])).cast("B"))


def get_arrays(uri: str, types: dict[str, type]) -> dict[str, np.ndarray]:
    """The arrays that put_arrays wrote, mapped as get_array does."""
    names = sorted(types, key=lambda x: -np.dtype(types[x]).itemsize)
    raw = get_array(uri, np.uint8)
    at = 8 * len(names)
    out = {}
    for x, n in zip(names, raw[:at].view(np.int64).tolist(), strict=True):
        size = n * np.dtype(types[x]).itemsize
        out[x], at = raw[at : at + size].view(types[x]), at + size
    return out
