"""What tasks have sent, written down while they send.

A job's outcomes become a table when the job ends.  Until then each task keeps
a journal in the shared folder: one JSON line per request, flushed before the next request goes
out.  A task that Spark repeats reads what its earlier attempts have noted and
goes on behind it; a job that is started again settles from the journals what
the interrupted one has sent.  A request that was under way when its task
ended is sent again, as nobody knows what became of it.

A line cut short by the end of a task is no line.  Stores that show a file only
once it is closed get a new file every ``LINES_PER_OBJECT`` requests.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark import TaskContext
from pyspark.sql import SparkSession

from millrace.session import qualified

LINES_PER_OBJECT = 64
_SHOWN_WHEN_CLOSED = {"s3", "gcs", "abfs"}

_FIELDS = (
    "request_id", "route_id", "batch_id", "part", "n_entries", "type", "url", "status", "body", "io_error",
)


@dataclass(frozen=True)
class Journal:
    """Journals of one run of a job, below one folder."""

    uri: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Journal | None:
        """None where tasks cannot write by themselves: the store must be one that
        Arrow's file systems know."""
        from pyarrow.fs import FileSystem

        try:
            uri = qualified(spark, path)
            filesystem, place = FileSystem.from_uri(uri)
            filesystem.create_dir(place, recursive=True)
        except Exception:  # noqa: BLE001 - unknown schemes and missing client libraries alike
            return None
        return cls(uri)

    def open(self) -> TaskJournal:
        context = TaskContext.get()
        return TaskJournal(self, context.partitionId(), context.taskAttemptId())


class TaskJournal:
    """The journal of one attempt of a task."""

    def __init__(self, journal: Journal, partition: int, attempt: int):
        from pyarrow.fs import FileSystem

        self._filesystem, self._folder = FileSystem.from_uri(journal.uri)
        self._prefix = f"{journal.run}-{partition}-"
        self._attempt, self._stream, self._lines, self._files = attempt, None, 0, 0
        self.known = self._earlier()

    def _earlier(self) -> dict[str, dict[str, Any]]:
        """Requests that earlier attempts of the same task have sent."""
        from pyarrow.fs import FileSelector

        known: dict[str, dict[str, Any]] = {}
        for info in self._filesystem.get_file_info(FileSelector(self._folder, allow_not_found=True)):
            if not info.base_name.startswith(self._prefix):
                continue
            with self._filesystem.open_input_stream(info.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        row = json.loads(line)
                        known[row["request_id"]] = row
                    except (ValueError, KeyError, TypeError):
                        continue  # cut short
        return known

    def add(self, request: dict[str, Any], status: int | None, body: str | None, io_error: str | None) -> None:
        values = {**request, "status": status, "body": body, "io_error": io_error}
        row = {name: getattr(values[name], "item", lambda v=values[name]: v)() for name in _FIELDS}
        if self._stream is None:
            name = f"{self._folder}/{self._prefix}{self._attempt}-{self._files}.json"
            self._stream, self._files = self._filesystem.open_output_stream(name), self._files + 1
        self._stream.write(json.dumps(row).encode() + b"\n")
        self._stream.flush()
        self._lines += 1
        if self._filesystem.type_name in _SHOWN_WHEN_CLOSED and self._lines % LINES_PER_OBJECT == 0:
            self.close()

    def close(self) -> None:
        if self._stream is not None:
            self._stream.close()
            self._stream = None
