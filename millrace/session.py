"""A session: statements of the dialect over stored tables and registered DataFrames."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.relational import lines, write_out
from millrace.plans.planner import Planner
from millrace.plans.statistics import Statistics
from millrace.plans.syntax import CreateTable, Drop, Insert, Select, SetOutput, parse_statement
from millrace.sources.catalog import schema_of
from millrace.sources.tables import Files, Store


class Session:
    def __init__(self, spark: SparkSession, store: str | None = None, data_dir: str | None = None, statistics: Statistics | None = None, out: TextIO | None = None):
        """store: folder of stored tables; data_dir: where INSERT looks for bare file names; out: where STDOUT goes."""
        self.spark, self.data_dir, self.statistics, self.out = spark, data_dir, statistics, out or sys.stdout
        self.store = Store(spark, store) if store else None
        self.frames: dict[str, DataFrame] = {}
        self.output, self.is_path = "STDOUT", False
        if self.store and self.store.files.exists(f"{self.store.path}/settings.json"):
            self.output, self.is_path = json.loads(self.store.files.read(f"{self.store.path}/settings.json"))

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame a table of this session."""
        self.frames[name] = df

    def register_parquet(self, folder: str, *names: str) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.store and name in self.store:
            return self.store.open(name).scan()
        raise ValueError(f"unknown table {name}")

    def query(self, text: str, bare: bool = True) -> DataFrame:
        """The DataFrame of a SELECT; nothing runs or is printed."""
        statement = parse_statement(text)
        if not isinstance(statement, Select):
            raise ValueError("not a SELECT")
        return self._planned(statement, bare)

    def _planned(self, statement: Select, bare: bool) -> DataFrame:
        return Planner(self.table, self.statistics).plan(statement, bare)

    def _stored(self) -> Store:
        if not self.store:
            raise ValueError("this session has no store")
        return self.store

    def execute(self, text: str) -> DataFrame | None:
        """Runs a statement. A SELECT goes to the output that is set and is returned; with NONE its plan is printed instead."""
        statement = parse_statement(text)
        if isinstance(statement, Select):
            df = self._planned(statement, bare=False)
            if self.output == "NONE" and not self.is_path:
                self.out.write(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) + "\n")
                return None
            if self.is_path:
                write_out(df, self.output)
            else:
                n = 0
                for row in lines(df).toLocalIterator():
                    self.out.write(row.value + "\n")
                    n += 1
                self.out.write(f"Query returned {n} records\n")
            return self._planned(statement, bare=True)
        if isinstance(statement, CreateTable):
            self._stored().create(statement.table, schema_of(list(statement.columns)), statement.kind, list(statement.on))
        elif isinstance(statement, Insert):
            path = statement.path if "/" in statement.path or not self.data_dir else f"{self.data_dir}/{statement.path}"
            self._stored().open(statement.table).load(path)
        elif isinstance(statement, Drop):
            self._stored().drop(statement.table)
        elif isinstance(statement, SetOutput):
            self.output, self.is_path = statement.to, statement.is_path
            if self.store:
                Files(self.spark).write(f"{self.store.path}/settings.json", json.dumps([self.output, self.is_path]))
        return None


def main(spark: SparkSession, session: Session, source: TextIO = sys.stdin) -> None:
    """One statement a line, until the end of the input; a problem is reported and the next line read."""
    for text in source:
        if text.strip():
            try:
                session.execute(text)
            except Exception as e:  # noqa: BLE001  a loop for people: report and go on
                session.out.write(f"{type(e).__name__}: {e}\n")
