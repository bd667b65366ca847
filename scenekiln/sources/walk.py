"""Files of a folder tree as a data source: sub-folders are listed side by side, and what cannot be listed or opened is a
row with the reason."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scenekiln.sources.files import MANIFEST, STAGED, filesystem

SCHEMA = "path string, size long, reason string"
#: Sub-folders that are looked for before listing is dealt out, and levels that are gone down for them.
FOLDERS, LEVELS = 64, 4
ROWS = 10_000


@dataclass
class Folder(InputPartition):
    """A folder, with all below it or only its own files."""

    path: str
    deep: bool


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> list[Folder]:
        """Folders of the first level that has enough of them; of those above only their own files are left."""
        fs, base = filesystem(self.root)
        shallow, level = [], [base]
        for _ in range(LEVELS):
            if not level or len(level) >= FOLDERS:
                break
            below = [i.path for path in level for i in _listed(fs, path) if i.type == pafs.FileType.Directory and not _own(i.base_name)]
            shallow += level
            level = below
        return [Folder(p, False) for p in shallow] + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(self.root)
        scheme = self.root.rstrip("/").removesuffix(base) if "://" in self.root else ""
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["path", "size", "reason"])

        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                found = _listed(fs, folder)
            except OSError as e:
                rows.append((scheme + folder, None, f"it cannot be listed: {e}"))
                found = []
            for info in found:
                if info.type == pafs.FileType.Directory and partition.deep and not _own(info.base_name):
                    todo.append(info.path)
                elif info.type == pafs.FileType.File and not _own(info.base_name):
                    rows.append((scheme + info.path, info.size, _unreadable(fs, info.path)))
                if len(rows) >= ROWS:
                    yield made()
                    rows = []
        if rows:
            yield made()


def _own(name: str) -> bool:
    """What unfinished commits have left is no content."""
    return name.startswith((STAGED, MANIFEST))


def _listed(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda i: i.path)


def _unreadable(fs: pafs.FileSystem, path: str) -> str | None:
    try:
        fs.open_input_file(path).close()
    except OSError as e:
        return f"it cannot be read: {e}"
    return None


class WalkSource(DataSource):
    """Source `folder_files`: path, size and, of what cannot be read, the reason."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(dict(self.options))
