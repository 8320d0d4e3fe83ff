"""Files in the shared folder, written and read inside tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def uri(path: str) -> str:
    """A URI that pyarrow takes: ``file:/x`` and ``/x`` become ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return "file://" + path if path.startswith("/") else path


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder; the folder is made where it is missing."""
    system, path = fs.FileSystem.from_uri(uri(folder))
    system.create_dir(path, recursive=True)
    return system, path


def fresh_name(prefix: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: a lost attempt's file is never listed in a manifest."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def reader(path: str):
    """A random-access file."""
    system, plain = fs.FileSystem.from_uri(uri(path))
    return system.open_input_file(plain)


def writer(system: fs.FileSystem, path: str):
    """A stream whose bytes land as they are (pyarrow would compress by the name's ending)."""
    return system.open_output_stream(path, compression=None)
