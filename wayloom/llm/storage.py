"""Files that tasks write and read themselves, on any file system that Arrow opens by its URI."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextmanager
def committed(path: str) -> Iterator:
    """An output stream whose file appears under its name only when it is complete.

    Each attempt of a task writes under a name of its own, so that a lost or doubled attempt
    leaves no half file; contents do not depend on the attempt, and the last one may replace an
    earlier one.
    """
    files, name = opened(path)
    task = TaskContext.get()
    own = f"{name}.{task.taskAttemptId() if task else 0}.tmp"
    files.create_dir(name.rpartition("/")[0], recursive=True)
    with files.open_output_stream(own) as out:
        yield out
    if files.get_file_info(name).type != fs.FileType.NotFound:
        files.delete_file(name)
    files.move(own, name)
