"""Binary files written by tasks to the shared folder."""

from __future__ import annotations

import os
import uuid


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under another name, then rename it: readers see all of it or nothing, and an
    attempt that runs twice leaves one file. `uri` is any that pyarrow opens (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    # Spark's readers skip names that begin with a dot.
    held = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(held) as out:
        out.write(data)
    system.move(held, path)
