"""The stored index: Parquet parts with an atomic pointer.

Every change writes new parts beside the old ones and then renames the pointer
file, so a reader sees either state and a failed change leaves none. A change
that only adds rows writes these and nothing else; a table of more than
``PARTS`` parts is written as one again. All access goes through the Hadoop
file systems, so the folder may lie on any of them.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnfold.schema import LAID_OUT, SCHEMAS, conform, empty, schema

_POINTER = "CURRENT"
#: Parts of a table above which a commit that adds to it writes it as one.
PARTS = 32


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root or root.startswith("file:") else os.path.abspath(root)
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)
        self._fs.mkdirs(self._path())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _state(self) -> dict[str, list[str]]:
        if not self._fs.exists(self._path(_POINTER)):
            return {}
        stream = self._fs.open(self._path(_POINTER))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, state: dict[str, list[str]]) -> None:
        draft = self._path(f".{_POINTER}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.hsync()
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(_POINTER)), options)

    def _parts(self, name: str, parts: list[str]) -> DataFrame:
        out = None
        for part in parts:
            stored = self.spark.read.schema(schema(name)).parquet(f"{self.root}/{part}")
            out = stored if out is None else out.unionByName(stored)
        return empty(self.spark, name) if out is None else out

    def read(self, name: str) -> DataFrame:
        """The rows of a table; columns that older parts lack are null."""
        return self._parts(name, self._state().get(name, []))

    def commit(self, add: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Writes the given tables anew and adds rows to others, all made current together; replaced parts are removed."""
        old, written, gone = self._state(), [], []
        try:
            new, gone = self._write(old, add or {}, tables, written)
            self._point(new)
        except Exception:
            gone = written
            raise
        finally:
            for part in gone:
                self._fs.delete(self._path(part), True)

    def _write(self, old: dict[str, list[str]], add: dict[str, DataFrame], tables: dict[str, DataFrame], written: list[str]) -> tuple[dict[str, list[str]], list[str]]:
        new, gone = dict(old), []
        for name, df in {**add, **tables}.items():
            if name not in SCHEMAS:
                raise ValueError(f"no table {name}")
            part = f"{name}-{uuid.uuid4().hex[:12]}"
            written.append(part)
            rows = conform(df, name)
            if name in tables:
                gone += old.get(name, [])
                new[name] = [part]
            elif len(old.get(name, [])) >= PARTS:
                rows, gone, new[name] = self._parts(name, old[name]).unionByName(rows), gone + old[name], [part]
            else:
                new[name] = [*old.get(name, []), part]
            by = LAID_OUT.get(name)
            writer = rows.write if by is None else rows.repartition(by).sortWithinPartitions(by, "token").write.partitionBy(by)
            writer.parquet(f"{self.root}/{part}")
        return new, gone
