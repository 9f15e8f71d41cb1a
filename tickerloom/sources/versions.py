"""Tables that are replaced as a whole or part by part, with readers that never see half of it.

Data files are written to a new folder and never change.  What a table holds is told by the newest file under ``commits``:
for each part its folders, from the oldest to the newest.  Creating that file is the commit: it fails if another writer has made the one
of that number, and until it is there every reader keeps to the one before.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tickerloom.session import lean

# Texts that repeat from row to row, as an article's do per entity, cost little with a window or dictionary that holds them.
FILES = {"compression": "zstd", "parquet.dictionary.page.size": str(8 * 1024 * 1024)}
PART = "_part"
WHOLE = "all"
FAN = 4
DEALT = "dealt by"
TORN_SECONDS = 600


class Conflict(RuntimeError):
    """Another writer was first."""


class Files:
    """The few operations on the session's own file systems that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _of(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def listed(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time in milliseconds) of what lies in a folder; nothing where there is no folder."""
        fs, place = self._of(path)
        if not fs.exists(place):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place))

    def create(self, path: str, text: str) -> None:
        """Make a file that must not be there yet."""
        fs, place = self._of(path)
        try:
            out = fs.create(place, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(path) from None
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, path: str) -> str:
        fs, place = self._of(path)
        stream = fs.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, place = self._of(path)
        fs.delete(place, True)


class Versions:
    """One table under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _commits(self) -> list[tuple[int, int]]:
        """(number, time) of all commits."""
        return [(int(name), at) for name, _, at in self.files.listed(f"{self.root}/commits") if name.isdigit()]

    def state(self) -> dict:
        """The newest commit: its number, the schema, the folders of each part, and notes."""
        for number, _ in reversed(self._commits()):
            try:
                return json.loads(self.files.text(f"{self.root}/commits/{number:020}")) | {"version": number}
            except ValueError:
                continue  # still being written
        return {"version": 0, "schema": None, "parts": {}, "notes": {}}

    def commit(self, state: dict) -> None:
        """Make the next version from a state that was read before; fails if there is a newer one."""
        known = self._commits()
        last, at = known[-1] if known else (0, 0)
        if last > state["version"]:
            try:
                json.loads(self.files.text(f"{self.root}/commits/{last:020}"))
                raise Conflict(f"{self.root}: version {last} came in between")
            except ValueError:
                if time.time() - at / 1000 < TORN_SECONDS:
                    raise Conflict(f"{self.root}: version {last} is being written") from None
        body = {k: v for k, v in state.items() if k != "version"}
        self.files.create(f"{self.root}/commits/{last + 1:020}", json.dumps(body))

    def write(self, df: DataFrame, parted: bool, gather: bool = True) -> dict[str, str]:
        """Store rows in a new folder; where each part of it lies.

        Rows of a part are gathered first, so that it has few files.  Rows made part by part from stored ones lie together
        already and are written where they are made, without ``gather``: a task then writes a file for each part it has rows of.
        """
        folder = self._new_folder()
        with lean(df.sparkSession):
            if not parted:
                df.write.options(**FILES).parquet(folder)
                return {WHOLE: folder}
            dealt = df.withColumn("part_dir", F.col(PART))
            (dealt.hint("rebalance", "part_dir") if gather else dealt).write.options(**FILES).partitionBy("part_dir").parquet(folder)
        return {name.removeprefix("part_dir="): f"{folder}/{name}" for name, _, _ in self.files.listed(folder) if name.startswith("part_dir=")}

    def _new_folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def write_each(self, made: Iterable[tuple[str, DataFrame]]) -> dict[str, str]:
        """Store parts one by one, in a job each.

        Rows of several parts are sorted by part to be written; here none are, so that rows which repeat
        wide texts go from where they are made to their file.
        """
        folder, kept = self._new_folder(), {}
        for part, rows in made:
            with lean(rows.sparkSession):
                rows.write.options(**FILES).parquet(f"{folder}/part_dir={part}")
            kept[part] = f"{folder}/part_dir={part}"
        return kept

    def exists(self) -> bool:
        return bool(self.state()["version"])

    def folders(self, parts: Iterable[str] | None = None, state: dict | None = None) -> list[str]:
        held = (state or self.state())["parts"]
        wanted = held if parts is None else [p for p in parts if p in held]
        return [folder for part in wanted for _, folder in held[part]]

    def stored(self, parts: Iterable[str] | None = None, state: dict | None = None) -> DataFrame:
        """The rows of some parts, or of all, as they were written; ``_part`` is among the columns if there are parts."""
        state = state or self.state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = self.folders(parts, state)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self.stored().drop(PART)

    def replace(self, df: DataFrame) -> DataFrame:
        """A new version of the whole table.  ``df`` may read the version that it replaces."""
        state = self.state()
        folders = self.write(df, False)
        self.commit(state | {"schema": df.schema.json(), "parts": {p: [[0, f]] for p, f in folders.items()}})
        return self.read()

    def replace_parts(self, df: DataFrame, parts: Iterable[str] | None = None, notes: dict | None = None, *more: DataFrame, gather: bool = True,
                      each: Iterable[tuple[str, DataFrame]] = ()) -> list[str]:
        """New contents of the named parts, or of all that ``df`` has in ``_part``; one without rows goes, the others stay.

        ``more`` and ``each``, which has its rows part by part, may have rows of the same columns for parts that ``df`` has none of.  The parts
        that were written.
        """
        state = self.state()
        folders = {p: f for rows in (df, *more) for p, f in self.write(rows, True, gather).items()} | self.write_each(each)
        parts = sorted(folders) if parts is None else parts
        held = {p: f for p, f in state["parts"].items() if p not in set(parts)} | {p: [[0, f]] for p, f in folders.items()}
        self.commit(state | {"schema": df.schema.json(), "parts": held, "notes": state["notes"] | (notes or {})})
        return sorted(folders)

    def note(self, **notes) -> None:
        state = self.state()
        self.commit(state | {"notes": state["notes"] | notes})

    def vacuum(self, keep: int = 2, strays: bool = True) -> None:
        """Delete the data that none of the last ``keep`` versions names, and the older commits.

        Without ``strays`` only what the older commits name goes, so that a writer that is still at work loses nothing.
        """
        numbers = [n for n, _ in self._commits()]
        needed, older = self._named(numbers[-keep:]), self._named(numbers[:-keep])
        if strays:
            self._delete_others(needed)
        else:
            for folder in older - needed:
                self.files.delete(folder)
        for n in numbers[:-keep]:
            self.files.delete(f"{self.root}/commits/{n:020}")

    def _named(self, numbers: Iterable[int]) -> set[str]:
        states = [json.loads(self.files.text(f"{self.root}/commits/{n:020}")) for n in numbers]
        return {folder for state in states for entries in state["parts"].values() for _, folder in entries}

    def _delete_others(self, needed: set[str]) -> None:
        for name, _, _ in self.files.listed(f"{self.root}/data"):
            folder = f"{self.root}/data/{name}"
            if folder in needed:
                continue
            parts = {f for f in needed if f.startswith(f"{folder}/")}
            if not parts:
                self.files.delete(folder)
                continue
            for part, _, _ in self.files.listed(folder):
                if part.startswith("part_dir=") and f"{folder}/{part}" not in parts:
                    self.files.delete(f"{folder}/{part}")


class Levels(Versions):
    """A reduced table that takes batches: one row per key, whatever the order of arrival.

    A batch is reduced by itself and added to the parts that it touches, as a folder of level 0.  FAN folders of
    a level in a part are merged into one of the next, so that a row is written again once per level and a
    read reduces at most FAN - 1 folders per level.  ``reduce`` must be idempotent and take its input in any order; ``part`` must
    depend on the key alone.
    """

    def __init__(self, spark: SparkSession, root: str, reduce: Callable[[DataFrame], DataFrame], part: Column, fan: int = FAN):
        super().__init__(spark, root)
        self.reduce, self.part, self.fan = reduce, part, fan

    def add(self, batch: DataFrame, run: str, number: int) -> None:
        """Add a batch; one that was added before is left out."""
        state = self.state()
        if state["notes"].get(run, -1) >= number:
            return
        dealt = state["notes"].get(DEALT, str(self.part))
        if dealt != str(self.part):
            raise ValueError(f"{self.root} is dealt by {dealt}, not by {self.part}")
        rows = self.reduce(batch).withColumn(PART, self.part)
        held = {p: list(f) for p, f in state["parts"].items()}
        for p, folder in self.write(rows, True).items():
            held.setdefault(p, []).append([0, folder])
        self.commit(state | {"schema": rows.schema.json(), "parts": held, "notes": state["notes"] | {run: number, DEALT: dealt}})
        while self._merge():
            pass

    def _merge(self) -> bool:
        """Merge the lowest level that is full in some part, in all parts where it is."""
        state = self.state()
        full = sorted({level for entries in state["parts"].values() for level, _ in entries
                       if sum(x == level for x, _ in entries) >= self.fan})
        if not full:
            return False
        level = full[0]
        old = {p: [f for x, f in entries if x == level] for p, entries in state["parts"].items() if sum(x == level for x, _ in entries) >= self.fan}
        schema = StructType.fromJson(json.loads(state["schema"]))
        rows = self.spark.read.schema(schema).parquet(*[f for folders in old.values() for f in folders]).drop(PART)
        made = self.write(self.reduce(rows).withColumn(PART, self.part), True)
        held = {p: [[x, f] for x, f in entries if p not in old or x != level] + ([[level + 1, made[p]]] if p in made and p in old else [])
                for p, entries in state["parts"].items()}
        self.commit(state | {"parts": held})
        return True

    def current(self) -> DataFrame:
        """One row per key; nothing is reduced where every part is one folder."""
        state = self.state()
        rows = self.stored(state=state).drop(PART)
        return rows if all(len(entries) == 1 for entries in state["parts"].values()) else self.reduce(rows)
