"""Search in sorted Parquet files from within tasks: only the row groups that wanted ranges meet are read.

Spark has no join that looks keys up in a sorted table; a shuffle join would
read all of it.  The files' bounds are in their footers; of many files only
those are opened that a binary search comes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq


def _opened(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class SortedFiles:
    """Files that, in the order given, are sorted by an integer column without nulls."""

    def __init__(self, paths: list[str], column: str):
        self.paths, self.column, self._footers = paths, column, {}

    def _footer(self, k: int) -> tuple[pq.FileMetaData, np.ndarray, np.ndarray]:
        """A file's metadata, and the least and the greatest value of each of its row groups that has rows."""
        if k not in self._footers:
            with _opened(self.paths[k]) as source:
                meta = pq.read_metadata(source)
            place = meta.schema.names.index(self.column)
            bounds = [(s.min, s.max) for s in (meta.row_group(g).column(place).statistics for g in range(meta.num_row_groups))]
            self._footers[k] = meta, np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
        return self._footers[k]

    def _first_ending_at(self, value: int, start: int) -> int:
        """The first file from ``start`` on whose last value is not below ``value``.  A file without rows, of which
        there's one at most and only in an empty table, ends before everything."""
        low, high = start, len(self.paths)
        while low < high:
            middle = (low + high) // 2
            lasts = self._footer(middle)[2]
            low, high = (middle + 1, high) if not len(lasts) or lasts[-1] < value else (low, middle)
        return low

    def pieces(self, low: np.ndarray, high: np.ndarray, columns: list[str]) -> Iterator[tuple[slice, pa.Table]]:
        """For ranges (both bounds included) that are sorted by either bound: each row group that some of them meet,
        with the slice of these ranges."""
        done, file = 0, 0
        while done < len(low):
            file = self._first_ending_at(int(low[done]), file)
            if file == len(self.paths):
                return
            meta, firsts, lasts = self._footer(file)
            begin, end = np.searchsorted(high, firsts, "left"), np.searchsorted(low, lasts, "right")
            met = np.flatnonzero(end > begin)
            if len(met):
                with _opened(self.paths[file]) as source:
                    reader = pq.ParquetFile(source, metadata=meta)
                    for g in met:
                        yield slice(int(begin[g]), int(end[g])), reader.read_row_group(int(g), columns)
            # ranges that reach this file's end or beyond it go on with the next one
            done, file = int(np.searchsorted(high, lasts[-1], "left")), file + 1
