"""A streaming source: the versions of the files in a folder, each once, when it has stopped changing.

A version is a name with a modification time and a size. Every trigger lists the folder, without reading a file. A version that
the listing before showed too (and that is old enough) is given out; a file still being written changes and waits; a file that is
written again is a new version. The offset is the listing itself, with a mark on what was given out: so a batch that is run
again has the same versions, a restart forgets nothing, and what has left the folder is forgotten. It is as large as the folder, not as
its history; move files away when they are done (``archive`` of the watched folder) to keep it small.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.text import EXTENSIONS

Listing = dict[str, list[int]]


def list_folder(folder: str) -> Listing:
    """name to (modification time in nanoseconds, size) of the files with known extensions directly in a folder; none where there is no folder."""
    files, root = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    known = [x for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and x.extension.lower() in EXTENSIONS]
    return {x.base_name: [x.mtime_ns or 0, x.size] for x in known}


def advance(before: Listing, now: Listing, most: int, latest_ns: int | None = None) -> Listing:
    """The listing with a mark: 1 for versions given out by now, 0 for others. ``before`` has marks, ``now`` has none.

    At most ``most`` versions more than before are given out, the oldest first; none that changed after ``latest_ns``.
    """
    after: Listing = {}
    for name, version in sorted(now.items(), key=lambda x: (x[1][0], x[0])):
        same = before.get(name, [None])[:2] == version
        mark = before[name][2] if same else 0
        if same and not mark and most > 0 and (latest_ns is None or version[0] <= latest_ns):
            mark, most = 1, most - 1
        after[name] = [*version, mark]
    return dict(sorted(after.items()))


def given_out(before: Listing, after: Listing) -> list[tuple[str, int, int]]:
    """(name, modification time, size) of the versions between two marked listings, the oldest first."""
    new = [(name, v[0], v[1]) for name, v in after.items() if v[2] and before.get(name) != v]
    return sorted(new, key=lambda x: (x[1], x[0]))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.most = int(options.get("mostFiles", 100))
        self.settled = float(options.get("settledSeconds", 0))
        self.pause = float(options.get("pauseSeconds", 0))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _rows(self, before: Listing, after: Listing) -> Iterator[tuple]:
        # a list's iterator: the engine copies it
        return iter([(f"{self.folder}/{name}", datetime.fromtimestamp(changed / 1e9, timezone.utc), size) for name, changed, size in given_out(before, after)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, latest = start["files"], time.time_ns() - int(self.settled * 1e9) if self.settled else None
        after = advance(before, list_folder(self.folder), self.most, latest)
        if self.pause and any(v[2] == 0 and before.get(name, [])[:2] != v[:2] for name, v in after.items()):
            # something new: look again soon instead of at the next trigger
            time.sleep(self.pause)
            after = advance(after, list_folder(self.folder), self.most - len(given_out(before, after)), latest)
        return self._rows(before, after), {"files": after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["files"], end["files"])


class FolderVersions(DataSource):
    """``spark.readStream.format("folder_versions").option("path", folder)``: path, modificationTime, length.

    Options: mostFiles (versions in one batch, 100), settledSeconds (least age, 0), pauseSeconds (a listing with something new is followed by
    a second one after so long, 0: at the next trigger).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_versions"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)
