"""The committed state of a set of files: a small document that names them, replaced by the next one at once.

Writers put their files beside those of the state and then commit the next manifest by a rename to a name that no other commit can
take. A writer that dies before that changes nothing; of two that start from the same state one fails. Readers see the last manifest only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str, first: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.state = self._last(first)

    def new_path(self, name: str) -> str:
        """A path for files of the next state."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _last(self, first: dict) -> tuple[int, dict]:
        _, fs, root = self._fs()
        fs.mkdirs(root)
        names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith("manifest-"))
        if not names:
            return 0, first
        rows = self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).collect()
        return int(names[-1].removeprefix("manifest-")), json.loads(rows[0].value)

    def commit(self, state: dict) -> None:
        hadoop, fs, root = self._fs()
        draft, final = hadoop.Path(self.new_path(".draft")), hadoop.Path(root, f"manifest-{self.version + 1:09d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise Conflict("the state was changed by another writer: open it again")
        self.version, self.state = self.version + 1, state
