"""Versions of a set of folders, of which readers see exactly one.

    <folder>/versions/<id>/<name>/…      the data of one load, never changed once named by a manifest
    <folder>/manifests/<number>.json     one small file for each accepted load, written last

A load writes its folders under an id of its own and then creates the next manifest, which is the one step that
makes it visible: nothing is moved or replaced, so it works alike on file systems and object stores. A reader takes the
manifest of the highest number that is complete, once, and reads the folders named there. A load that dies before leaves
an id that no manifest names, and one that dies while it writes the manifest leaves a file that readers pass over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

_FORMAT = 1


@dataclass(frozen=True)
class Version:
    """One accepted load: its number, its id, and where each of its names lies."""

    number: int
    id: str
    paths: dict[str, str]


class VersionedFolder:
    """The versions below ``folder``, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.folder}/{below}" if below else self.folder)

    def _listed(self, below: str) -> list[str]:
        path = self._path(below)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def numbers(self) -> list[int]:
        """The numbers of all manifests, the newest first, complete or not."""
        stems = (name.removesuffix(".json") for name in self._listed("manifests") if name.endswith(".json"))
        return sorted((int(s) for s in stems if s.isdigit()), reverse=True)

    def version(self, number: int) -> Version | None:
        """The version of a manifest; None if its file is missing or was not written to its end."""
        path = self._path(f"manifests/{number:012d}.json")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            told = json.loads(text)
        except ValueError:
            return None
        if told.get("format") != _FORMAT:
            raise ValueError(f"{path} has a format this release does not know")
        return Version(number, told["id"], {name: f"{self.folder}/versions/{told['id']}/{name}" for name in told["names"]})

    def latest(self) -> Version | None:
        """The newest version, None before the first load."""
        return next((v for v in map(self.version, self.numbers()) if v), None)

    def new_id(self) -> str:
        return uuid.uuid4().hex

    def staging(self, id_: str) -> str:
        """Where a load with this id writes its folders."""
        return f"{self.folder}/versions/{id_}"

    def accept(self, id_: str, names: Iterable[str]) -> Version:
        """Makes the folders of a load the newest version.

        A number is taken by creating its file, which fails where it exists: of two loads that end together each becomes a
        version, the later one the newest.
        """
        names = list(names)
        body = bytearray(json.dumps({"format": _FORMAT, "id": id_, "names": names}), "utf-8")
        number = max(self.numbers(), default=0) + 1
        while True:
            path = self._path(f"manifests/{number:012d}.json")
            try:
                stream = self._files.create(path, False)
            except Exception:
                if not self._files.exists(path):
                    raise
                number += 1
                continue
            try:
                stream.write(body)
            finally:
                stream.close()
            return Version(number, id_, {name: f"{self.staging(id_)}/{name}" for name in names})

    def discard(self, id_: str) -> None:
        """Removes the folders of a load that was refused."""
        self._files.delete(self._path(f"versions/{id_}"), True)

    def vacuum(self, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
        """Removes versions beyond the newest ``keep``, and folders of loads that died; returns their ids.

        Folders that no manifest names are left alone for ``older_than_hours``, as a load may be writing them.
        Readers of a removed version fail from then on, so ``keep`` must cover the readers still at work.
        """
        if keep < 1:
            raise ValueError("the newest version must be kept")
        complete = [v for v in map(self.version, self.numbers()) if v]
        kept, old = {v.id for v in complete[:keep]}, complete[keep:]
        for v in old:  # the manifest first: no reader may find a version whose folders are gone
            self._files.delete(self._path(f"manifests/{v.number:012d}.json"), False)
        now = self.spark._jvm.System.currentTimeMillis()
        gone = [v.id for v in old]
        for id_ in self._listed("versions"):
            age = now - self._files.getFileStatus(self._path(f"versions/{id_}")).getModificationTime()
            if id_ not in kept and id_ not in gone and age > older_than_hours * 3_600_000:
                gone.append(id_)
        for id_ in gone:
            self.discard(id_)
        return gone
