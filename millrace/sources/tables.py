"""Stored tables: heaps, and tables sorted on keys.

A table is a folder of Parquet data and of small numbered description files, the latest of
which lists the parts that make up the table. An append writes a part of its own, sorted on
the keys in a sorted table, and then the next description; that number is taken by whoever
creates the file first, and who comes second reads the new list and takes the number after
it, so appends at the same time lose no rows. Reads change nothing: they take all parts
listed, and predicates on the first keys skip row groups by their bounds. compact() merges
parts of like size, so a row is rewritten a few times only however many appends there are;
parts that are no longer listed stay for readers that began earlier, until vacuum().
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.columns import quoted
from millrace.operators.relational import order_on_all, select_pipe, sort
from millrace.plans.syntax import Cnf
from millrace.sources.text import read_text

HEAP, SORTED = "heap", "sorted"
#: Parts of a tier that are merged into one of the next.
TIER = 8


class Files:
    """What is needed of the file system under Spark, whichever store it is."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def age(self, path: str) -> float:
        """Seconds since it was last changed."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self._at(path)
        out = fs.create(p, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file as one step: it is written under another name first, then renamed over the old one."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        self._put(draft, text, True)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        (_, source), (fs, target) = self._at(draft), self._at(path)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(source, target, options)

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there; False if it is, also if somebody else creates it just now."""
        try:
            self._put(path, text, False)
        except Exception:
            if self.exists(path):
                return False
            raise
        return True

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Table:
    """A stored table of a store; see Store.create and Store.open."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def _state(self) -> dict:
        """The latest description that is complete. One that stays incomplete was left by a writer that died, and doesn't count."""
        for wait in (0.0, 0.1, 0.4, 1.5):
            time.sleep(wait)
            found = [n for n in self.files.names(self.path) if n.startswith("state-") and n.endswith(".json")]
            if not found:
                raise FileNotFoundError(f"no table at {self.path}")
            states = [self._parsed(n) for n in found[-1:]]
            if states[0] is not None:
                return states[0]
        earlier = [x for n in found if (x := self._parsed(n)) is not None]
        return earlier[-1] | {"number": int(found[-1][6:-5])}

    def _parsed(self, name: str) -> dict | None:
        try:
            return json.loads(self.files.read(f"{self.path}/{name}"))
        except ValueError:
            return None

    def _become(self, state: dict) -> bool:
        """Whether this is now the table's description; False if somebody else's came first."""
        state = state | {"number": state["number"] + 1}
        return self.files.create(f"{self.path}/state-{state['number']:08d}.json", json.dumps(state))

    @property
    def kind(self) -> str:
        return self._state()["kind"]

    @property
    def keys(self) -> list[str]:
        return self._state()["keys"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._state()["schema"])

    def load(self, path: str) -> None:
        """Appends the rows of a text file."""
        self.append(read_text(self.spark, path, self.schema))

    def append(self, df: DataFrame) -> None:
        """Adds the rows as a part."""
        state = self._state()
        rows = df.select(*(quoted(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        part = self._written(rows, state, 0)
        while not self._become(state | {"parts": [*state["parts"], part]}):
            state = self._state()

    def _written(self, rows: DataFrame, state: dict, tier: int) -> dict:
        folder = f"part-{uuid.uuid4().hex}"
        if state["kind"] == SORTED:
            keys = [quoted(k) for k in state["keys"]]
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "tier": tier}

    def compact(self, full: bool = False) -> None:
        """Merges parts: where a tier has `TIER` parts or more, they become one of the next; with full all become one."""
        while True:
            state = self._state()
            tiers = {p["tier"] for p in state["parts"]}
            old = state["parts"] if full else next((same for t in sorted(tiers) if len(same := [p for p in state["parts"] if p["tier"] == t]) >= TIER), [])
            if len(old) < 2:
                return
            part = self._written(self._read(old), state, max(p["tier"] for p in old) + 1)
            while all(p in state["parts"] for p in old) and not self._become(state | {"parts": [part, *(p for p in state["parts"] if p not in old)]}):
                state = self._state()  # parts may have come, or somebody else has merged these: then ours isn't listed and goes with vacuum()

    def vacuum(self, older_than: float = 86_400.0) -> None:
        """Deletes parts and descriptions that the table no longer needs, and that are that many seconds old."""
        state = self._state()
        needed = {p["folder"] for p in state["parts"]} | {f"state-{state['number']:08d}.json"}
        for n in self.files.names(self.path):
            if n not in needed and (n.startswith("part-") or n < f"state-{state['number']:08d}.json" and n.startswith("state-")) and self.files.age(f"{self.path}/{n}") >= older_than:
                self.files.delete(f"{self.path}/{n}")

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p['folder']}" for p in parts))

    def scan(self, where: str | Cnf | None = None) -> DataFrame:
        """The rows, or those that satisfy the predicate, in no order."""
        df = self._read(self._state()["parts"])
        return select_pipe(df, where) if where else df

    def sorted_scan(self, where: str | Cnf | None = None) -> DataFrame:
        """The same in the order of the keys."""
        return sort(self.scan(where), self.keys)


class Store:
    """Tables in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def create(self, name: str, schema: T.StructType, kind: str = HEAP, keys: list[str] | None = None) -> Table:
        """A sorted table without keys is sorted on all columns: Ints, Doubles, then Strings."""
        if kind not in (HEAP, SORTED):
            raise ValueError(f"a table is {HEAP} or {SORTED}, not {kind}")
        if name in self:
            raise ValueError(f"there is a table {name}")
        if missing := [k for k in keys or [] if k not in schema.names]:
            raise ValueError(f"{name} has no column {', '.join(missing)}")
        if kind == SORTED and not keys:
            keys = order_on_all(self.spark.createDataFrame([], schema))
        table = Table(self.spark, f"{self.path}/{name}")
        if not table._become({"number": 0, "kind": kind, "keys": list(keys or []), "schema": schema.jsonValue(), "parts": []}):
            raise ValueError(f"there is a table {name}")
        return table

    def sink(self, name: str, df: DataFrame, keys: list[str] | None = None) -> Table:
        """A new sorted table with the rows of df."""
        table = self.create(name, df.schema, SORTED, keys)
        table.append(df)
        return table

    def open(self, name: str) -> Table:
        if name not in self:
            raise FileNotFoundError(f"no table {name} in {self.path}")
        return Table(self.spark, f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self.open(name)
        self.files.delete(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n in self]

    def __contains__(self, name: str) -> bool:
        return any(n.startswith("state-") for n in self.files.names(f"{self.path}/{name}"))
