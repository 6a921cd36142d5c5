"""A store folder: versions of tables, and numbered manifests that name the valid ones.

A commit writes new versions of some tables first and then one manifest. Readers take the
manifest with the highest number, so they see all tables of a commit or none, and a job
that dies leaves the store as it was. A manifest is made under a temporary name and renamed
to its number; where that number is there already, another writer was faster and the
commit is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from engram.operators.checkpoints import HEADER
from engram.sources.schema import SPECS, schema

MANIFEST = "manifest-"
#: Tables beside those of ``schema``.
OTHERS = {"checkpoints": HEADER, "topics": "boundary string, topic_id int, label string, id string"}


class CommitConflict(RuntimeError):
    """Another writer committed in the meantime; read again and repeat."""


class StoreFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.number, self._versions = self._newest()

    def _at(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def _newest(self) -> tuple[int, dict[str, str]]:
        if not self._fs.exists(self._at("")):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        numbers = [int(n[len(MANIFEST) :]) for n in names if n.startswith(MANIFEST)]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/{MANIFEST}{max(numbers):012d}", wholetext=True).first().value
        return max(numbers), json.loads(text)

    def read(self, name: str) -> DataFrame:
        """The table as of the manifest that this object read last; empty where it was never written."""
        if name in self._versions:
            return self.spark.read.parquet(f"{self.path}/{self._versions[name]}")
        return self.spark.createDataFrame([], schema(name) if name in SPECS else OTHERS[name])

    def commit(self, **tables: DataFrame) -> None:
        """Replaces the named tables, all at once."""
        made = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
        for name, rows in tables.items():
            rows.write.option("compression", "zstd").parquet(f"{self.path}/{made[name]}")
        whole = self._versions | made
        target, draft = self._at(f"{MANIFEST}{self.number + 1:012d}"), self._at(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(whole, sort_keys=True).encode("utf-8")))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            for gone in [draft, *[self._at(v) for v in made.values()]]:
                self._fs.delete(gone, True)
            raise CommitConflict(f"manifest {self.number + 1} is there already")
        self.number, self._versions = self.number + 1, whole

    def sweep(self, kept: int = 2) -> None:
        """Removes manifests but the newest ``kept`` and the versions that none of those names.

        Versions without a manifest may belong to a commit under way: sweep while nobody writes.
        """
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        numbers = sorted((n for n in names if n.startswith(MANIFEST)), reverse=True)
        valid = set(numbers[:kept])
        for n in numbers[:kept]:
            valid |= set(json.loads(self.spark.read.text(f"{self.path}/{n}", wholetext=True).first().value).values())
        for n in names:
            if n not in valid and not n.startswith("."):
                self._fs.delete(self._at(n), True)
