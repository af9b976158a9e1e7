"""Locks on items that hold between threads and between processes on one machine or one shared file system."""

from __future__ import annotations

import fcntl
import os
import threading
from pathlib import Path


class ItemLock:
    """Re-entrant in its thread; a file lock keeps other processes out, and is given up when the process dies."""

    def __init__(self, path: Path):
        self.path, self._thread, self._depth, self._file = path, threading.RLock(), 0, None

    def acquire(self, blocking: bool = True) -> bool:
        if not self._thread.acquire(blocking):
            return False
        if self._depth == 0:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            file = os.open(self.path, os.O_RDWR | os.O_CREAT, 0o644)
            try:
                fcntl.flock(file, fcntl.LOCK_EX | (0 if blocking else fcntl.LOCK_NB))
            except BlockingIOError:
                os.close(file)
                self._thread.release()
                return False
            self._file = file
        self._depth += 1
        return True

    def release(self) -> None:
        self._depth -= 1
        if self._depth == 0:
            file, self._file = self._file, None
            os.close(file)
        self._thread.release()

    def __enter__(self) -> ItemLock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
