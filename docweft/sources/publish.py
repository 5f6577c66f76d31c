"""A two-phase writer of files by path: a batch's files appear all or none, and unchanged ones are left alone.

Data source `published_files` (columns path, content). Tasks stage what has changed under a folder of their attempt beside
the target and send back what they staged; the driver's commit holds that list against a journal, moves old files aside
and new ones in, and deletes the journal last. An abort, or a commit that fails on the way, puts the old files back and
clears the staging; a writer that finds a journal of a driver that died does the same before it begins. Contents equal to
the file there are not written, so their times stay and a second run writes nothing.

The folder must be one that driver and executors share (a path of the shared file system, not of one machine). Options:
path, the folder; fail_at, a relative path whose move fails (for tests of recovery).

Defined results: two rows of one path are an error, as is a path that leaves the folder or is null; null content deletes
the file. An empty DataFrame changes nothing. A task killed in the middle may leave staged files under `.staging`, where
nothing looks for them.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging"


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Staged(WriterCommitMessage):
    """What a task staged: (relative path, staged file or None for a deletion)."""

    files: list[tuple[str, str | None]]


class PublishedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Publisher(_local(self.options["path"]), self.options.get("fail_at"))


class Publisher(DataSourceWriter):
    def __init__(self, root: str, fail_at: str | None):
        self.root, self.fail_at = root, fail_at
        self.staging = os.path.join(root, STAGING, uuid.uuid4().hex)
        recover(root)

    def write(self, rows: Iterator) -> Staged:
        folder = os.path.join(self.staging, uuid.uuid4().hex)  # of this attempt alone
        files, seen = [], set()
        for path, content in rows:
            if path is None or path.startswith("/") or ".." in path.split("/") or path.split("/")[0] == STAGING:
                raise ValueError(f"not a path inside the folder: {path}")
            if path in seen:
                raise ValueError(f"two contents for {path}")
            seen.add(path)
            target = os.path.join(self.root, path)
            if content is None:
                if os.path.exists(target):
                    files.append((path, None))
                continue
            data = content.encode()
            if os.path.exists(target) and os.path.getsize(target) == len(data) and _digest(target) == hashlib.sha256(data).digest():
                files.append((path, ""))
                continue
            staged = os.path.join(folder, f"{len(files)}")
            os.makedirs(folder, exist_ok=True)
            with open(staged, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            files.append((path, staged))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        every = [x for m in messages if m for x in m.files]
        if len({path for path, _ in every}) < len(every):
            self.abort(messages)
            raise ValueError("two contents for one path")
        moves = [(path, staged) for path, staged in every if staged != ""]
        if moves:
            os.makedirs(self.staging, exist_ok=True)
            journal = os.path.join(self.staging, "journal")
            with open(journal + ".new", "w", encoding="utf-8") as f:
                json.dump([(path, staged, os.path.exists(os.path.join(self.root, path))) for path, staged in moves], f)
            os.replace(journal + ".new", journal)
            try:
                for k, (path, staged) in enumerate(moves):
                    target, old = os.path.join(self.root, path), os.path.join(self.staging, f"old-{k}")
                    if path == self.fail_at:
                        raise OSError(f"cannot move {path}")
                    if os.path.exists(target):
                        os.replace(target, old)
                    if staged is not None:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        os.replace(staged, target)
            except OSError:
                recover(self.root)
                raise
            os.remove(journal)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        try:
            os.rmdir(os.path.join(self.root, STAGING))
        except OSError:  # another batch is staging
            pass


def _digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def recover(root: str) -> None:
    """Puts back what an unfinished commit has moved: what its journal names goes, and the old files return."""
    top = os.path.join(root, STAGING)
    for batch in os.listdir(top) if os.path.isdir(top) else ():
        journal = os.path.join(top, batch, "journal")
        if not os.path.exists(journal):
            continue
        with open(journal, encoding="utf-8") as f:
            moves = json.load(f)
        for k, (path, staged, there) in enumerate(moves):
            target, old = os.path.join(root, path), os.path.join(top, batch, f"old-{k}")
            if os.path.exists(old):
                os.replace(old, target)
            elif not there and staged is not None and not os.path.exists(staged) and os.path.exists(target):
                os.remove(target)  # it has come in and had no predecessor
        shutil.rmtree(os.path.join(top, batch), ignore_errors=True)


def publish(files: DataFrame, root: str, **options: str) -> None:
    """Publishes files(path, content) under a folder, all or none."""
    files.sparkSession.dataSource.register(PublishedFiles)
    files.select("path", "content").write.format("published_files").mode("append").options(path=root, **options).save()
