"""A sink of whole files, tar archives or plain ones, that commits in two phases.

Tasks write into a staging folder, each attempt into one of its own, so attempts that run twice or side by side on other
hosts never meet; what fails leaves nothing but staging. When all tasks are done, the commit is one small file, the
manifest of the new generation: which staged files go where, and which earlier ones go. Once it is there the generation
stands, and moving its files can be taken up by anyone who meets the manifest, again and again, until it is done: the
next writer, or a reader that lists the folder. Until then the earlier generation is whole.

Names of files are what the driver holds, one for each file written.
"""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scenekiln.session import is_local

#: Files that are moved at once.
MOVERS = 16
STAGED, MANIFEST = "_staged-", "_commit-"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a URI, or of a path on this machine."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _move(fs: pafs.FileSystem, a: str, b: str) -> None:
    """Move what has not been moved yet."""
    try:
        if _there(fs, a):
            fs.move(a, b)
    except OSError:
        if _there(fs, a) or not _there(fs, b):  # else another has just moved it
            raise


def settle(fs: pafs.FileSystem, base: str) -> int:
    """Finish commits of `base` that have a manifest; returns how many. Can be done twice and by several at once."""
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.is_file and i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json")]
    for path in sorted(found):
        try:
            with fs.open_input_stream(path) as f:
                plan = json.loads(f.read())
        except FileNotFoundError:
            continue  # another has just finished it
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: _move(fs, f"{base}/{m[0]}", f"{base}/{m[1]}"), plan["moves"]))
        for name in plan["drops"]:
            if _there(fs, f"{base}/{name}"):
                fs.delete_file(f"{base}/{name}")
        if _there(fs, f"{base}/{plan['staged']}"):
            fs.delete_dir(f"{base}/{plan['staged']}")
        if _there(fs, path):
            fs.delete_file(path)
    return len(found)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task's attempt, as they are staged and as they will be named."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class FilesWriter(DataSourceWriter):
    """Writes rows (file, name, payload), sorted by file: tar archives, or plain files where name is null."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.replaced = options["path"], options.get("replaces", "")
        self.job = uuid.uuid4().hex

    def _base(self) -> tuple[pafs.FileSystem, str]:
        return filesystem(self.folder)

    def write(self, rows: Iterator) -> Written:
        fs, base = self._base()
        own = f"{STAGED}{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{own}", recursive=True)
        at = out = tar = None
        moves: list[tuple[str, str]] = []

        def close() -> None:
            if tar is not None:
                tar.close()
            if out is not None:
                out.close()

        for row in rows:
            if row.file != at:
                close()
                at, tar = row.file, None
                if "/" in row.file or row.file[:1] in ("", ".", "_"):
                    raise ValueError(f"not a name of a file: {row.file!r}")
                moves.append((f"{own}/{row.file}", row.file))
                out = fs.open_output_stream(f"{base}/{own}/{row.file}")
                if row.name is not None:
                    tar = tarfile.open(fileobj=out, mode="w|")
            if tar is None:
                out.write(bytes(row.payload))
            else:
                info = tarfile.TarInfo(row.name)
                info.size = len(row.payload)
                tar.addfile(info, io.BytesIO(bytes(row.payload)))
                tar.members.clear()
        close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._base()
        fs.create_dir(base, recursive=True)
        settle(fs, base)
        moves = [m for message in messages if message is not None for m in message.moves]
        names = {name for _, name in moves}
        earlier = fs.get_file_info(pafs.FileSelector(base)) if self.replaced else []
        drops = [i.base_name for i in earlier if i.is_file and i.base_name.startswith(f"{self.replaced}-") and i.base_name.endswith(".tar") and i.base_name not in names]
        plan = {"staged": f"{STAGED}{self.job}", "moves": moves, "drops": drops}
        with fs.open_output_stream(f"{base}/{MANIFEST}{self.job}.tmp") as f:
            f.write(json.dumps(plan).encode())
        fs.move(f"{base}/{MANIFEST}{self.job}.tmp", f"{base}/{MANIFEST}{self.job}.json")  # from here on the generation stands
        settle(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._base()
        if _there(fs, f"{base}/{STAGED}{self.job}"):
            fs.delete_dir(f"{base}/{STAGED}{self.job}")


class FilesSource(DataSource):
    """Write-only source `scene_files` of rows (file string, name string, payload binary). Option `replaces`: a prefix of
    which earlier shards go with the commit."""

    @classmethod
    def name(cls) -> str:
        return "scene_files"

    def schema(self) -> str:
        return "file string, name string, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(dict(self.options))


def write_files(rows: DataFrame, folder: str, order: list[str], replaces: str = "") -> None:
    """Rows (file, name, payload, *order) as files: each file whole in one task, members in order.

    `replaces`: earlier shards of this prefix go when the new ones come, not before. A folder without a scheme is this
    machine's disk, and so an error on a cluster."""
    if "://" not in folder and not folder.startswith("file:") and not is_local(rows.sparkSession):
        raise ValueError("on a cluster the folder to write to must be a URI that all executors reach")
    rows.sparkSession.dataSource.register(FilesSource)
    dealt = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "name", "payload")
    dealt.write.format("scene_files").mode("append").option("replaces", replaces).save(folder)
