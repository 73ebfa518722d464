"""Files of chosen names with their rows in order: a batch sink whose files appear together, when the driver commits.

Each file is written by one task as a stream, so a file of any size needs little memory. An attempt writes into a folder of its own
below ``_pending``; the commit moves the files of the successful attempts to their names and writes ``_manifest.json`` last, so
what a killed task or job leaves behind is never taken for a file of the export.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "huskwatch_ordered_files"
MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: its folder and (name, bytes, SHA-256) per file."""
    folder: str
    files: list[tuple[str, int, str]]


def _store(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:/", folder) else (fs.LocalFileSystem(), folder)


def check_name(name: str | None) -> str:
    """A relative name below the export's folder; parts that begin with a dot or an underscore are kept for the sink."""
    if not name or any(not part or part[0] in "._" for part in name.split("/")):
        raise ValueError(f"not a name for a file of the export: {name!r}")
    return name


class OrderedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.folder)
        attempt = f"{root}/_pending/{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, int, str]] = []
        seen: set[str] = set()
        out = name = None
        size, digest = 0, hashlib.sha256()
        for row in iterator:
            if out is None or row[0] != name:
                if out is not None:
                    out.close()
                    files.append((name, size, digest.hexdigest()))
                name = check_name(row[0])
                if name in seen:
                    raise ValueError(f"rows of {name!r} are not together")
                seen.add(name)
                store.create_dir(f"{attempt}/{name}".rsplit("/", 1)[0], recursive=True)
                out, size, digest = store.open_output_stream(f"{attempt}/{name}"), 0, hashlib.sha256()
            data = (row[1] or "").encode("utf-8", "surrogatepass")
            out.write(data)
            size += len(data)
            digest.update(data)
        if out is not None:
            out.close()
            files.append((name, size, digest.hexdigest()))
        return Written(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.folder)
        listed: dict[str, dict] = {}
        for message in messages:
            for name, size, digest in message.files if message else ():
                if name in listed:
                    raise ValueError(f"two tasks wrote {name!r}")
                listed[name] = {"bytes": size, "sha256": digest}
        for message in messages:
            for name, _, _ in message.files if message else ():
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{message.folder}/{name}", f"{root}/{name}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{self.job}") as out:
            out.write(json.dumps(listed, sort_keys=True, indent=1).encode())
        store.move(f"{root}/_manifest-{self.job}", f"{root}/{MANIFEST}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store, root: str) -> None:
        from pyarrow.fs import FileType
        if store.get_file_info(f"{root}/_pending/{self.job}").type == FileType.Directory:
            store.delete_dir(f"{root}/_pending/{self.job}")


class OrderedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> OrderedFilesWriter:
        return OrderedFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, *order: str | Column) -> None:
    """Write rows (file, text and the order columns): the texts of a file one after the other, as they are, in ``order``.

    Null texts are empty; a null or unsuitable file name is an error, and nothing appears. No rows: a manifest without files.
    The names of all files meet in the driver, so they should be sessions, platforms or the like, not rows."""
    rows.sparkSession.dataSource.register(OrderedFiles)
    placed = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "text")
    placed.write.format(FORMAT).mode("append").option("path", folder).save()


def file_part(value: Column) -> Column:
    """A value as a part of a file name: itself where it suits, else with other characters replaced and a digest added."""
    safe = F.regexp_replace(value, r"[^A-Za-z0-9.\-_]", "_")
    suits = (safe == value) & value.rlike(r"^[A-Za-z0-9]")
    return F.when(suits, value).otherwise(F.concat(F.lit("x"), safe, F.lit("-"), F.substring(F.sha2(value, 256), 1, 12)))
