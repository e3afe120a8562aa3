"""Tables that change together: what a transaction writes to several tables appears at once, or not at all.

A transaction writes its rows to a folder of its own and then commits by one file in ``_commits``, put in place by a rename that fails if
another transaction has taken the number. Readers take the rows of committed folders only. A transaction has a name; under a name that
is committed already, nothing is written, so a batch that is repeated after a failure adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from causeway.session import ship


class Ledger:
    """A folder of tables. ``schemas``: DDL by table."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(hadoop)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), hadoop)
        self._never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def commits(self) -> list[dict]:
        """name, folder and tables of each transaction, in order."""
        at = self._path(f"{self.path}/_commits")
        if not self._files.exists(at):
            return []
        names = sorted(x.getPath().getName() for x in self._files.listStatus(at))
        return [json.loads(self._read(f"{self.path}/_commits/{n}")) for n in names if n.endswith(".json")]

    def table(self, name: str) -> DataFrame:
        """All committed rows."""
        folders = [f"{c['folder']}/{name}" for c in self.commits() if name in c["tables"]]
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, txn: str, tables: dict[str, DataFrame]) -> bool:
        """Writes all of ``tables``, or none; false if a transaction of this name is there already."""
        ship(self.spark)
        if any(c["name"] == txn for c in self.commits()):
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            rows.select(*columns).write.parquet(f"{folder}/{name}")
        note = f"{folder}/commit.json"
        self._write(note, json.dumps({"name": txn, "folder": folder, "tables": sorted(tables)}))
        self._files.mkdirs(self._path(f"{self.path}/_commits"))
        while True:
            before = self.commits()
            if any(c["name"] == txn for c in before):
                self._files.delete(self._path(folder), True)
                return False
            if self._take(note, f"{self.path}/_commits/{len(before):020d}.json"):
                return True

    def _take(self, note: str, place: str) -> bool:
        try:
            self._context.rename(self._path(note), self._path(place), self._never)
        except Exception as e:  # py4j tells of a Java exception by its text
            if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def _write(self, path: str, text: str) -> None:
        out = self._files.create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        data = self._files.open(self._path(path))
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()
