"""Tar shards as a data source. Members are found header by header, and a payload is a byte range.

A reader seeks from one header to the next, so an index of a shard costs its headers and not its images, whatever a shard's
size; payloads are read for the members that are asked for alone. Shards over RANGE_BYTES are read by several tasks, each
of which takes the members whose headers begin in its range. Filters on shard, ext and key are applied while headers are
read, as pushed filters or as options. Compressed shards have no ranges: they are read as a stream by one task.

Files are opened through Arrow's file systems, by URI; nothing is held but one batch of payloads and one member.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from scenekiln.sources.files import filesystem, settle

SCHEMA = "shard string, ord long, key string, ext string, offset long, size long, payload binary"
#: Bytes of a shard that one task reads at least, tasks of a shard at most, bytes of payloads in a batch.
RANGE_BYTES, MAX_RANGES, BATCH_BYTES = 256 << 20, 32, 16 << 20
#: Bytes that are read ahead of a header; a shard of at most SMALL bytes is read at once.
AHEAD, SMALL = 1 << 10, 1 << 20
#: Small shards share a task: of so many bytes at least, and of a part of all bytes.
TASK_BYTES, TASKS = 8 << 20, 256
_PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")


class Ranged(io.RawIOBase):
    """A file of any store that reads what it is asked for, and counts it."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self._file, self._at, self.taken = fs.open_input_file(path), 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self._file.size() if whence == 2 else 0)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, into) -> int:
        data = self.range(self._at, len(into))
        into[: len(data)] = data
        self._at += len(data)
        return len(data)

    def size(self) -> int:
        return self._file.size()

    def range(self, offset: int, size: int) -> bytes:
        data = self._file.read_at(size, offset)
        self.taken += len(data)
        return data

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


def packed(file: Ranged) -> bool:
    """Whether the shard is compressed."""
    return file.range(0, 6).startswith(_PACKED)


@dataclass(frozen=True)
class Asked:
    """Members that are asked for; None: all."""

    exts: frozenset[str] | None = None
    keys: frozenset[str] | None = None

    def admits(self, key: str, ext: str) -> bool:
        return (self.exts is None or ext in self.exts) and (self.keys is None or key in self.keys)


def members(file: Ranged, uri: str, asked: Asked, payload: bool, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA: regular files whose name has a dot, in order, whose headers begin in the range."""
    streamed = packed(file)
    if streamed:
        start, end = 0, None
    file.seek(0)
    with tarfile.open(fileobj=file if streamed else io.BufferedReader(file, AHEAD if file.size() > SMALL else SMALL), mode="r|*" if streamed else "r:") as tar:
        at = -1
        while (member := tar.next()) is not None and (end is None or member.offset < end):
            at += 1
            tar.members.clear()  # the archive would keep all it has passed
            key, dot, ext = member.name.partition(".")
            if member.offset < start or not member.isfile() or not dot or not asked.admits(key, ext):
                continue
            whole = not streamed and not member.issparse()
            data = None
            if payload:
                data = file.range(member.offset_data, member.size) if whole else tar.extractfile(member).read()
            yield uri, at, key, ext, member.offset_data if whole else None, member.size, data


def batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA in batches of bounded bytes."""
    kinds = [("shard", pa.string()), ("ord", pa.int64()), ("key", pa.string()), ("ext", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())]
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*held), kinds)], [name for name, _ in kinds])

    for row in rows:
        held.append(row)
        size += 128 + len(row[-1] or b"")
        if size > BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


@dataclass
class Part(InputPartition):
    """Pieces (uri, start, end): the members of a shard whose headers begin in a range of bytes."""

    pieces: list[tuple[str, int, int]]


class MembersReader(DataSourceReader):
    """Reads the `*.tar` of a folder, or a single shard."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.payload = options.get("payload", "true") == "true"
        named = lambda option: frozenset(json.loads(options[option])) if options.get(option) else None
        self.shards, self.asked = named("shards"), Asked(named("exts"), named("keys"))

    def partitions(self) -> list[Part]:
        fs, base = filesystem(self.folder)
        scheme = self.folder.rstrip("/").removesuffix(base) if "://" in self.folder else ""
        found = fs.get_file_info(base)
        if found.type == pafs.FileType.Directory:
            settle(fs, base)
            files = [i for i in fs.get_file_info(pafs.FileSelector(base)) if i.is_file and i.base_name.endswith(".tar") and i.base_name[0] not in "._"]
        else:
            files = [found] if found.is_file else []
        pieces = []
        for info in sorted(files, key=lambda i: i.path):
            uri = scheme + info.path
            if self.shards is not None and uri not in self.shards:
                continue
            ranges = 1
            if info.size > RANGE_BYTES:
                with Ranged(uri) as file:
                    ranges = 1 if packed(file) else min(MAX_RANGES, -(-info.size // RANGE_BYTES))
            edges = [info.size * i // ranges for i in range(ranges + 1)]
            pieces += [(uri, a, b if b < info.size else info.size + 1) for a, b in pairwise(edges)] if info.size else [(uri, 0, 1)]
        return dealt(pieces) or [Part([])]  # a reader has a partition at least

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batches(self._members(partition))

    def _members(self, partition: Part) -> Iterator[tuple]:
        for uri, start, end in partition.pieces:
            with Ranged(uri) as file:
                yield from members(file, uri, self.asked, self.payload, start, end)


def dealt(pieces: list[tuple[str, int, int]]) -> list[Part]:
    """Pieces in order, as many to a task as make up its bytes: a task costs more than a small shard."""
    most = min(RANGE_BYTES, max(TASK_BYTES, sum(end - start for _, start, end in pieces) // TASKS))
    out, held = [], 0
    for piece in pieces:
        size = piece[2] - piece[1]
        if not out or held + size > most:
            out.append(Part([]))
            held = 0
        out[-1].pieces.append(piece)
        held += size
    return out


class PushedReader(MembersReader):
    """Takes filters on shard, ext and key, for sessions that push them to data sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        found = {"shard": self.shards, "ext": self.asked.exts, "key": self.asked.keys}
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in found:
                yield f
                continue
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            found[column] = values if found[column] is None else found[column] & values
        self.shards, self.asked = found["shard"], Asked(found["ext"], found["key"])


class MembersSource(DataSource):
    """Source `tar_members`. Options: `payload` (false: none is read), `exts`, `keys`, `shards` (JSON lists), `push`."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("push") == "true" else MembersReader)(options)


def fetched(some: Iterator[pa.RecordBatch], into: str) -> Iterator[pa.RecordBatch]:
    """Batches with shard, ord, offset and size, and with the payloads as column `into`; each shard is opened once in a row."""
    opened: tuple[str, Ranged] | None = None
    for batch in some:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "ord", "offset", "size"))))
        streams = _streamed([(shard, at) for shard, at, offset, _ in rows if offset is None and shard is not None])
        first, held, total = 0, [], 0
        for i, (shard, at, offset, size) in enumerate(rows):
            if shard is None:
                held.append(None)
            elif offset is None:
                held.append(streams[shard, at])
            else:
                if opened is None or opened[0] != shard:
                    if opened is not None:
                        opened[1].close()
                    opened = shard, Ranged(shard)
                held.append(opened[1].range(offset, size))
            total += len(held[-1] or b"")
            if total > BATCH_BYTES or i == len(rows) - 1:
                yield batch.slice(first, len(held)).append_column(into, pa.array(held, pa.binary()))
                first, held, total = i + 1, [], 0
    if opened is not None:
        opened[1].close()


def _streamed(wanted: list[tuple[str, int]]) -> dict[tuple[str, int], bytes]:
    """Payloads of members that have no range: of compressed shards, and sparse ones."""
    out, by = {}, {}
    for shard, at in wanted:
        by.setdefault(shard, set()).add(at)
    for shard, places in by.items():
        with Ranged(shard) as file, tarfile.open(fileobj=file, mode="r|*") as tar:
            at = -1
            while (member := tar.next()) is not None and len(places) > sum(s == shard for s, _ in out):
                at += 1
                tar.members.clear()
                if at in places:
                    out[shard, at] = tar.extractfile(member).read()
    return out
