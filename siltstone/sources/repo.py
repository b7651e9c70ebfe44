"""A repository folder as a Spark data source: a batch of its files, and a stream of their changes."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from siltstone.sources.config import SKIP_DIRS

FILES = "file_path string, content binary, size_bytes bigint, modified_at timestamp"
CHANGES = "file_path string, op string, modified_at timestamp"
#: Folders that the driver opens at most; whatever is below them is listed and read in tasks.
OPENED = 256
PARTS = 64


def _fail(error: OSError) -> None:
    raise error


def _walk(root: str, folder: str, skip_dirs: list[str], deep: bool = True) -> Iterator[tuple[str, list[str], list[str]]]:
    """(folder, sub-folders, files) relative to root in lexical order, without hidden ones and folders to skip."""
    for at, folders, names in os.walk(os.path.join(root, folder), onerror=_fail):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in skip_dirs)
        own = os.path.relpath(at, root)
        join = (lambda n: n) if own == "." else (lambda n: os.path.join(own, n))
        yield own, [join(f) for f in folders], [join(n) for n in sorted(names) if not n.startswith(".")]
        if not deep:
            return


def listed(root: str, skip_dirs: list[str]) -> Iterator[tuple[str, int, float]]:
    """(relative path, size, time) of the files below root.

    Hidden folders and files and the folders to skip are left out; the root may be hidden, but not
    have a name that is skipped. A folder that can't be read ends the listing with its error.
    """
    if os.path.basename(os.path.abspath(root)) in skip_dirs:
        return
    for _, _, paths in _walk(root, ".", skip_dirs):
        for path in paths:
            try:
                info = os.stat(os.path.join(root, path))
            except FileNotFoundError:
                continue
            yield path, info.st_size, info.st_mtime


class Part(InputPartition):
    def __init__(self, folders: list[str], files: list[str]) -> None:
        super().__init__(None)
        self.folders, self.files = folders, files


class RepoReader(DataSourceReader):
    """The driver opens folders breadth first until there are OPENED of them; tasks list what is below those and read all contents.

    The folder must be mounted under the same name wherever tasks run.
    """

    def __init__(self, root: str, skip_dirs: list[str]) -> None:
        self.root, self.skip_dirs = root, skip_dirs

    def partitions(self) -> list[Part]:
        if os.path.basename(os.path.abspath(self.root)) in self.skip_dirs:
            return [Part([], [])]
        waiting, files = deque(["."]), []
        opened = 0
        while waiting and opened < OPENED:
            _, folders, names = next(_walk(self.root, waiting.popleft(), self.skip_dirs, deep=False))
            waiting.extend(folders)
            files += names
            opened += 1
        folders = list(waiting)
        count = max(1, min(PARTS, len(folders) + -(-len(files) // 16)))
        return [Part(folders[i::count], files[i::count]) for i in range(count)]

    def read(self, partition: Part) -> Iterator[tuple]:
        below = (path for folder in partition.folders for _, _, names in _walk(self.root, folder, self.skip_dirs) for path in names)
        for path in chain(partition.files, below):
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    content = f.read()
                when = datetime.fromtimestamp(os.stat(full).st_mtime, timezone.utc)
            except OSError:  # unreadable files count as binary
                continue
            yield path, content, len(content), when


class ChangeReader(SimpleDataSourceStreamReader):
    """Compares the listing with the last one: created, modified and removed files.

    Listings lie in the folder `state`, numbered; an offset is the number of one. Those that no batch needs any more are removed.
    """

    def __init__(self, root: str, skip_dirs: list[str], state: str) -> None:
        self.root, self.skip_dirs, self.state = root, skip_dirs, state

    def _file(self, n: int) -> str:
        return os.path.join(self.state, f"listing-{n:012d}.json")

    def _load(self, n: int) -> dict[str, float]:
        if not n:
            return {}
        with open(self._file(n), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _between(self, old: dict[str, float], new: dict[str, float]) -> Iterator[tuple]:
        rows = []
        for path in sorted({*old, *new}):
            if old.get(path) != new.get(path):
                op = "remove" if path not in new else "write" if path in old else "create"
                rows.append((path, op, datetime.fromtimestamp(new.get(path, old.get(path)), timezone.utc)))
        return iter(rows)  # Spark copies the iterator, which a generator doesn't allow

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, now = self._load(start["listing"]), {p: t for p, _, t in listed(self.root, self.skip_dirs)}
        if old == now:
            return iter([]), start
        n = start["listing"] + 1
        os.makedirs(self.state, exist_ok=True)
        with open(f"{self._file(n)}.new", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(f"{self._file(n)}.new", self._file(n))
        return self._between(old, now), {"listing": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(self._load(start["listing"]), self._load(end["listing"]))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if name.startswith("listing-") and name < os.path.basename(self._file(end["listing"] - 1)):
                os.remove(os.path.join(self.state, name))


class RepoSource(DataSource):
    """spark.read.format("repo").load(root): files; spark.readStream.format("repo").option("mode", "changes").load(root): changes.

    Options: skip_dirs, names with commas; state, for changes: the folder that keeps listings, beside the checkpoint.
    """

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return FILES if self.options.get("mode", "files") == "files" else CHANGES

    def _arguments(self) -> tuple[str, list[str]]:
        skip = self.options.get("skip_dirs")
        return self.options["path"], SKIP_DIRS if skip is None else [s for s in skip.split(",") if s]

    def reader(self, schema) -> RepoReader:
        return RepoReader(*self._arguments())

    def simpleStreamReader(self, schema) -> ChangeReader:
        if not self.options.get("state"):
            raise ValueError("option state must name a folder for listings")
        return ChangeReader(*self._arguments(), self.options["state"])
