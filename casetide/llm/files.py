"""Files that tasks write and read in the shared folder, through any file system that Arrow knows."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder given as a path or URI."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def new_name(prefix: str, suffix: str) -> str:
    """Name that no other attempt of a task uses; only a manifest says which files count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


@contextlib.contextmanager
def writing(root: str, name: str):
    """Stream into a new file of the folder."""
    system, path = opened(root)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield out
