"""Section files as a Spark sink: tasks write the files, the commit makes them visible, meta.json of a year last.

A task's files stand in a folder of the run until all tasks are done. The driver only renames them, so no text passes through it; a
failed run leaves no section and no meta.json behind. Files are opened by pyarrow.fs (local and shared folders, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

META = "meta.json"


@dataclass
class _Written(WriterCommitMessage):
    """(year, file, where it stands) of a task's files."""

    files: list[tuple[str, str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator):
        fs, root = self._fs()
        files = []
        for row in iterator:
            if not files:
                fs.create_dir(f"{root}/{self.run}", recursive=True)
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{root}/{self.run}/{name}") as out:
                out.write((row["value"] or "").encode())
            files.append((str(row["year"]), row["file"], name))
        return _Written(files)

    def commit(self, messages):
        fs, root = self._fs()
        files = [f for m in messages if m is not None for f in m.files]
        for year in {y for y, _, _ in files}:
            fs.create_dir(f"{root}/{year}", recursive=True)
        for year, file, name in sorted(files, key=lambda f: f[1] == META):
            fs.move(f"{root}/{self.run}/{name}", f"{root}/{year}/{file}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(files)}).encode())
        self.abort(messages)

    def abort(self, messages):
        fs, root = self._fs()
        if fs.get_file_info(f"{root}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")


class SectionFiles(DataSource):
    """df(year, file, value).write.format("section_files").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "section_files"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"])


def written(path: str) -> int:
    """How many files the last run made visible."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root.rstrip('/')}/_SUCCESS") as said:
        return json.loads(said.read())["files"]
