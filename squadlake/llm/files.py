"""Files that tasks write to the shared folder beside Spark's own tables."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI; needed inside tasks, which get URIs only."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def attempt_name(part: int, number: int, suffix: str) -> str:
    """A name no other attempt of the task uses: a task that runs twice leaves an
    extra file behind, and the job's manifest names the one that counts."""
    return f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex[:12]}.{suffix}"
