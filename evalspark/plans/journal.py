"""A journal of paid calls: what one attempt of a task has finished, the next one does not pay for again.

A pass has a folder in shared storage. Every task attempt writes a file of its own there, one
line per finished key, and reads the files of the attempts before it when it starts. Keys are
dealt to tasks by their hash over a fixed number of tasks, which the folder remembers, so a key
is always looked for where it was written. A torn last line is a call that was not finished.

On a mounted file system each line leaves the process before its row is handed on, and is forced to
disk when the last time was ``SYNC_SECONDS`` ago; on other stores a file appears when it is closed, so
there a file holds at most ``SEGMENT`` keys.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import datetime

#: A lost machine, not a lost process, may cost the calls of this time again.
SYNC_SECONDS = 0.5
#: Keys per file on stores whose files appear when they are closed.
SEGMENT = 32
#: Columns of a call that are moments in time.
TIMES = ("request_started_at", "response_received_at")


def _mounted(folder: str) -> str | None:
    """The path of a folder that is mounted here, else None."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if "://" not in folder else None


@dataclass(frozen=True)
class Journal:
    """The journal of one pass; travels to the tasks."""

    folder: str

    def _files(self, place: str) -> list[str]:
        """Contents of the files below a place, oldest name first."""
        path = _mounted(self.folder)
        if path is not None:
            where = os.path.join(path, place)
            names = sorted(os.listdir(where)) if os.path.isdir(where) else []
            return [open(os.path.join(where, n), encoding="utf-8", errors="replace").read() for n in names]
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{root}/{place}", allow_not_found=True))
        return [store.open_input_stream(f.path).read().decode("utf-8", "replace") for f in sorted(found, key=lambda f: f.path)]

    def tasks(self, wanted: int) -> int:
        """The pass's number of tasks: the one it was begun with, else the one that is wanted now."""
        known = self._files("tasks")
        if known:
            return int(known[0])
        writer = Writer(self, "tasks")
        writer.put(str(wanted))
        writer.close()
        return wanted

    def finished(self, task: int) -> dict[str, list[dict]]:
        """Rows of every key that an earlier attempt of a task has finished; the earliest reply counts."""
        out: dict[str, list[dict]] = {}
        for text in self._files(f"task-{task:06d}"):
            for line in text.split("\n"):
                try:
                    rows = json.loads(line)
                except json.JSONDecodeError:
                    continue  # torn, or the end of the file
                for row in rows:
                    row.update({t: datetime.fromisoformat(row[t]) for t in TIMES})
                key = rows[0]["call_key"]
                if key not in out or rows[-1][TIMES[1]] < out[key][-1][TIMES[1]]:
                    out[key] = rows
        return out

    def writer(self, task: int) -> Writer:
        return Writer(self, f"task-{task:06d}")


class Writer:
    """One attempt's lines; used by all threads of the attempt."""

    def __init__(self, journal: Journal, place: str) -> None:
        self._journal, self._place, self._lock = journal, place, threading.Lock()
        self._file, self._lines, self._synced = None, [], 0.0

    def record(self, rows: list[dict]) -> None:
        """Keep the attempts of one finished key."""
        self.put(json.dumps([{k: v.isoformat() if k in TIMES else v for k, v in row.items()} for row in rows]))

    def put(self, line: str) -> None:
        path = _mounted(self._journal.folder)
        with self._lock:
            if path is None:
                self._lines.append(line)
                if len(self._lines) >= SEGMENT:
                    self._segment()
                return
            if self._file is None:
                os.makedirs(os.path.join(path, self._place), exist_ok=True)
                self._file = open(os.path.join(path, self._place, f"{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")
            self._file.write(line + "\n")
            self._file.flush()
            if time.monotonic() - self._synced >= SYNC_SECONDS:
                os.fsync(self._file.fileno())
                self._synced = time.monotonic()

    def _segment(self) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self._journal.folder)
        store.create_dir(f"{root}/{self._place}", recursive=True)
        with store.open_output_stream(f"{root}/{self._place}/{uuid.uuid4().hex}.jsonl") as out:
            out.write(("\n".join(self._lines) + "\n").encode())
        self._lines = []

    def close(self) -> None:
        with self._lock:
            if self._lines:
                self._segment()
            if self._file is not None:
                os.fsync(self._file.fileno())
                self._file.close()
                self._file = None
