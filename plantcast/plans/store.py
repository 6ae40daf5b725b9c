"""Versioned folders and the store of fitted models built on them.

A version is written under a number of its own and counts once its mark exists, so a reader never sees half a version and
a failed writer leaves the last one in place. Numbers are claimed by creating a file that must not exist yet.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.operators.boosting import in_parallel
from plantcast.session import checkpoint_root


class Versions:
    """Numbered versions under ``root``: ``version=N`` holds the data, ``_claims/N`` and ``_done/N`` are empty marks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        folder = self._path(f"{self.root}/{kind}")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def folder(self, number: int) -> str:
        return f"{self.root}/version={number}"

    def latest(self) -> int | None:
        """Number of the last finished version."""
        return max(self._numbers("_done"), default=None)

    def claim(self) -> int:
        """A number that no other writer has."""
        number = max(self._numbers("_claims"), default=0) + 1
        while not self._fs.createNewFile(self._path(f"{self.root}/_claims/{number}")):
            number += 1
        return number

    def publish(self, number: int) -> None:
        if not self._fs.createNewFile(self._path(f"{self.root}/_done/{number}")):
            raise ValueError(f"{self.root}: version {number} exists")


def frames_content(frames: Mapping[str, DataFrame]) -> list[list]:
    """Name, columns, number of rows and sum of row hashes of each frame, in any order of rows. The frames are read side by side."""

    def content(name: str, df: DataFrame) -> list:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
        return [name, sorted(df.columns), row.n, str(row.h)]

    return in_parallel([lambda name=name, df=df: content(name, df) for name, df in sorted(frames.items())])


def content_key(frames: Mapping[str, DataFrame] | list[list], settings: Mapping) -> str:
    """Key of rows and settings. ``frames`` may be what ``frames_content`` found, so that several keys read them once."""
    parts = frames if isinstance(frames, list) else frames_content(frames)
    return hashlib.sha256(json.dumps([parts, settings], sort_keys=True, default=str).encode()).hexdigest()[:32]


class ModelStore:
    """Fitted models by name and content key: fitted and saved once, loaded from then on."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{checkpoint_root(spark).rstrip('/')}/models").rstrip("/")

    def folder(self, name: str, key: str, fit: Callable[[str], None]) -> str:
        """Folder of the saved model. ``fit`` is called with a new folder if there is none; two that fit at once both save, and
        the later one counts."""
        versions = Versions(self.spark, f"{self.root}/{name}-{key}")
        if (found := versions.latest()) is None:
            found = versions.claim()
            fit(versions.folder(found))
            versions.publish(found)
        return versions.folder(found)
