"""What runs leave behind in the shared folder: steps found again by what made them, and results that are replaced chunk by chunk.

*Steps.*  ``Steps`` names a table by a fingerprint of all that it depends on (revisions of tables, settings), so a second query that asks for
the same step reads it.  A step is written beside its place and moved there, so a half-written one is never found.

*Runs.*  A ``RunStore`` holds the current results of a scene set.  A run writes its rows and the chunks that it answers for as a part of its own, then one small
pointer file names the parts that count from then on; readers see either all of a run or nothing of it.  For each chunk the latest part
that answers for it counts, so a chunk that is sent again replaces what was there.  ``clear`` begins a new generation: what runs of
an older one bring in is dropped.  Pointers are numbered and made only where none is, so of two commits at once one is refused.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder

#: So many parts are read at most; then they are written as one.
MOST_PARTS = 8


class RunCanceled(RuntimeError):
    """COMPUTE_CANCELED: the run was stopped, and the baseline with it; the next run is a full one."""


def fingerprint(*parts: object) -> str:
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()[:32]


def target_revision(zone_ids: list[str], volumes: list[tuple]) -> str:
    """The part of a fingerprint that tells a group's target zones; the order of zones and volumes (id, position, rotation, size) carries no meaning."""
    if not zone_ids:
        return ""
    spelt = (f"{i}:{':'.join(','.join(map(str, v)) for v in rest)}" for i, *rest in volumes)
    return ",".join(sorted(zone_ids)) + "|" + ";".join(sorted(spelt))


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._of = lambda name="": hadoop.Path(f"{path}/{name}" if name else path)
        self.fs = self._of().getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._of(name))) if self.has(name) else []

    def move(self, old: str, new: str) -> bool:
        """False, and nothing moved, where ``new`` is there already."""
        self.fs.mkdirs(self._of(new).getParent())
        return not self.has(new) and self.fs.rename(self._of(old), self._of(new))

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._of(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._of(name), False)
        out.write(text.encode())
        out.close()

    def text(self, name: str) -> str:
        return self.spark.sparkContext.wholeTextFiles(f"{self.path}/{name}").values().first()

    def _files(self) -> list[tuple[str, int, int]]:
        found, each = [], self.fs.listFiles(self._of(), True)
        while each.hasNext():
            s = each.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)

    def sizes(self) -> dict[str, int]:
        """The bytes of all files below."""
        return {name: size for name, size, _ in self._files()}

    def revision(self) -> str:
        """Names, sizes and times of all files below: another one after any change."""
        return fingerprint(*self._files())


class Steps:
    """Tables that are kept by what made them."""

    def __init__(self, spark: SparkSession):
        self.folder = Folder(spark, f"{shared_folder(spark)}/kept")

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        spark, place = self.folder.spark, f"{self.folder.path}/{key}"
        if not self.folder.has(f"{key}/_SUCCESS"):
            made, beside = make(), f"new-{uuid.uuid4().hex}"
            made.write.parquet(f"{self.folder.path}/{beside}")
            if not self.folder.move(beside, key):  # another query was first, with the same rows
                self.folder.delete(beside)
        return spark.read.parquet(place)

    def forget(self, key: str) -> bool:
        return self.folder.delete(key)

    def keys(self) -> list[str]:
        return [n for n in self.folder.names() if not n.startswith("new-")]

    def clear(self) -> None:
        self.folder.delete()


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs inside bear ``tag``; if ``cancel`` stops them, ``RunCanceled`` is raised."""
    _canceled.discard(tag)
    spark.sparkContext.addJobTag(tag)
    try:
        yield
        if tag in _canceled:
            raise RunCanceled(tag)
    except RunCanceled:
        raise
    except Exception as e:
        if tag in _canceled:
            raise RunCanceled(tag) from e
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)


_canceled: set[str] = set()


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs of a run, from any thread; a run that has ended is left alone."""
    _canceled.add(tag)
    spark.sparkContext.cancelJobsWithTag(tag)


class RunStore:
    """The current results of runs: tables with a ``chunk_id``, with what they were made from."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self._lock = spark, Folder(spark, f"{shared_folder(spark)}/runs/{name}"), threading.Lock()

    def _pointer(self) -> tuple[int, dict]:
        names = self.folder.names("pointers")
        if not names:
            return -1, {"generation": 0, "parts": [], "about": None, "cameras": None}
        return int(names[-1].split(".")[0]), json.loads(self.folder.text(f"pointers/{names[-1]}"))

    def _point(self, number: int, to: dict) -> bool:
        beside = f"new-{uuid.uuid4().hex}"
        self.folder.write(beside, json.dumps(to))
        done = self.folder.move(beside, f"pointers/{number:09d}.json")
        if not done:
            self.folder.delete(beside)
        return done

    @property
    def generation(self) -> int:
        """The token that a run takes before it begins."""
        return self._pointer()[1]["generation"]

    @property
    def about(self) -> dict | None:
        """What the current results were made from (settings, descriptor); None before any run."""
        return self._pointer()[1]["about"]

    def clear(self) -> None:
        """No results any more; runs that are under way count as stale."""
        with self._lock:
            while True:
                number, now = self._pointer()
                if self._point(number + 1, {"generation": now["generation"] + 1, "parts": [], "about": None, "cameras": None}):
                    return

    def drop(self, token: int) -> None:
        """No results any more, but the generation stays: after a run of it that was stopped or failed."""
        with self._lock:
            while True:
                number, now = self._pointer()
                if now["generation"] != token or self._point(number + 1, {"generation": token, "parts": [], "about": None, "cameras": None}):
                    return

    def commit(self, token: int, rows: DataFrame, chunks: DataFrame, about: dict, cameras: DataFrame | None = None, incremental: bool = False) -> bool:
        """Take over a run: ``rows`` for the ``chunks`` (chunk_id) that it answers for, instead of what was there or, if ``incremental``, of these chunks alone.

        False, and nothing taken over, if the token's generation is over.
        """
        if self.generation != token:
            return False
        name = uuid.uuid4().hex
        part, seen_by = f"parts/{name}", cameras is not None and f"cameras/{name}" or None
        rows.write.parquet(f"{self.folder.path}/{part}/rows")
        chunks.select("chunk_id").distinct().write.parquet(f"{self.folder.path}/{part}/chunks")
        if cameras is not None:
            cameras.write.parquet(f"{self.folder.path}/{seen_by}")
        with self._lock:
            number, now = self._pointer()
            parts = [*now["parts"], part] if incremental else [part]
            to = {"generation": token, "parts": parts, "about": about, "cameras": seen_by}
            if now["generation"] == token and self._point(number + 1, to):
                if len(parts) > MOST_PARTS:
                    self._fold(number + 1, to)
                return True
        for left in filter(None, (part, seen_by)):
            self.folder.delete(left)
        return False

    def _fold(self, number: int, of: dict) -> None:
        """Write all parts as one."""
        part = f"parts/{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.folder.path}/{part}/rows")
        self.chunks().write.parquet(f"{self.folder.path}/{part}/chunks")
        if not self._point(number + 1, of | {"parts": [part]}):
            self.folder.delete(part)

    def cameras(self) -> DataFrame | None:
        """The cameras of the current results."""
        place = self._pointer()[1]["cameras"]
        return place and self.spark.read.parquet(f"{self.folder.path}/{place}")

    def _each(self, what: str) -> DataFrame | None:
        out = None
        for n, part in enumerate(self._pointer()[1]["parts"]):
            rows = self.spark.read.parquet(f"{self.folder.path}/{part}/{what}").withColumn("_part", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out

    def chunks(self) -> DataFrame | None:
        """The chunks that there are results for, those without rows too."""
        found = self._each("chunks")
        return found and found.select("chunk_id").distinct()

    def read(self) -> DataFrame | None:
        """The current rows, each chunk's from the latest part that answers for it; None before any run."""
        rows = self._each("rows")
        if rows is None or len(self._pointer()[1]["parts"]) == 1:
            return rows and rows.drop("_part")
        last = self._each("chunks").groupBy("chunk_id").agg(F.max("_part").alias("_part"))
        return rows.join(last, ["chunk_id", "_part"], "left_semi").drop("_part")

    def vacuum(self) -> None:
        """Delete parts and pointers that don't count any more."""
        number, now = self._pointer()
        for name in self.folder.names("parts"):
            if f"parts/{name}" not in now["parts"]:
                self.folder.delete(f"parts/{name}")
        for name in self.folder.names("cameras"):
            if f"cameras/{name}" != now["cameras"]:
                self.folder.delete(f"cameras/{name}")
        for name in self.folder.names("pointers"):
            if int(name.split(".")[0]) < number:
                self.folder.delete(f"pointers/{name}")
