"""Tables in versioned buckets that are replaced together.

``{path}/data/{table}/v={version}/{bucket}`` has the rows of the buckets that a version rewrote, and one small file
``{path}/manifest/{version}.json`` names the version of every bucket of every table.  A manifest is written
under another name and then renamed, so a version is there as a whole or not at all, and readers of an
older one are not disturbed: rows may be computed from the version that they replace.  A bucket that loses its
last row is left out of the manifest.  A version that is tried again writes the same folders again.  Of old
versions KEEP are kept; manifests and buckets that only older ones name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEEP = 2


@dataclass(frozen=True)
class Table:
    """Columns (DDL), the columns whose hash chooses a row's bucket, and the number of buckets."""

    schema: str
    key: tuple[str, ...]
    buckets: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    @property
    def mark(self) -> str:
        """Name of the bucket in paths, one that no column has."""
        name = "bucket"
        while name in {c.lower() for c in self.columns}:
            name += "_"
        return name


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), dict(tables)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions that are still kept, ascending."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict[str, dict[int, int]]:
        """Table to bucket to the version that has its rows."""
        reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(self._fs.open(self._at(f"manifest/{version}.json")), "UTF-8"))
        try:
            return {t: {int(b): v for b, v in buckets.items()} for t, buckets in json.loads(reader.readLine()).items()}
        finally:
            reader.close()

    def current(self, below: int | None = None) -> dict[str, dict[int, int]]:
        """The newest manifest (older than ``below``), empty if there is none."""
        found = [v for v in self.versions() if below is None or v < below]
        return self.manifest(found[-1]) if found else {}

    def read(self, table: str, below: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of the newest version (older than ``below``), of some buckets only if they are given."""
        t, held = self.tables[table], self.current(below).get(table, {})
        paths = [f"{self.path}/data/{table}/v={v}/{t.mark}={b}" for b, v in sorted(held.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(t.schema).parquet(*paths) if paths else self.spark.createDataFrame([], t.schema)

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets of ``keys``, which have the table's key columns; at most as many numbers as buckets come to the driver."""
        return sorted(r.b for r in keys.select(self.tables[table].bucket().alias("b")).distinct().collect())

    def commit(self, version: int, changes: Mapping[str, tuple[DataFrame, Sequence[int] | None]]) -> None:
        """Makes ``version`` current: per table the whole rows of some buckets (None: of all), other buckets and tables stay."""
        out = self.current(version)
        for name, (rows, buckets) in changes.items():
            t, folder = self.tables[name], f"data/{name}/v={version}"
            held = {} if buckets is None else {b: v for b, v in out.get(name, {}).items() if b not in set(buckets)}
            if buckets is None or len(buckets):
                rows.select(*t.columns).withColumn(t.mark, t.bucket()).repartition(t.mark).write.mode("overwrite").partitionBy(t.mark).parquet(f"{self.path}/{folder}")
                held |= {int(n.split("=")[1]): version for n in self._names(folder) if n.startswith(f"{t.mark}=")}
            out[name] = held
        text = json.dumps({t: {str(b): v for b, v in sorted(buckets.items())} for t, buckets in out.items()})
        new, final = self._at(f"manifest/{version}.new"), self._at(f"manifest/{version}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(final):  # the same version, tried again
            self._fs.delete(final, False)
        if not self._fs.rename(new, final):
            raise OSError(f"{final.toString()} was not written")
        self._drop_old()

    def replace(self, version: int, changes: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> None:
        """Commits per table ``(owners, rows, on)``: all rows whose ``on`` columns are in ``owners`` give way to ``rows``.

        ``owners`` has the ``on`` columns and the table's key.  Only buckets of owners and rows are read and written.
        """
        whole = {}
        for name, (owners, rows, on) in changes.items():
            t = self.tables[name]
            buckets = self.touched(name, owners.select(*t.key).unionByName(rows.select(*t.key)))
            old = self.read(name, version, buckets)
            whole[name] = (old.join(owners.select(*on).distinct(), list(on), "left_anti").select(*t.columns).unionByName(rows.select(*t.columns)), buckets)
        self.commit(version, whole)

    def _drop_old(self) -> None:
        found = self.versions()
        live: set[tuple[str, str, str]] = set()
        for v in found[-KEEP:]:
            live |= {(t, f"v={at}", f"{self.tables[t].mark}={b}") for t, buckets in self.manifest(v).items() if t in self.tables for b, at in buckets.items()}
        used = {(t, v) for t, v, _ in live}
        for v in found[:-KEEP]:
            self._fs.delete(self._at(f"manifest/{v}.json"), False)
        for t in self.tables:
            for v in self._names(f"data/{t}"):
                if not v.startswith("v=") or int(v[2:]) >= found[-1]:
                    continue
                if (t, v) not in used:
                    self._fs.delete(self._at(f"data/{t}/{v}"), True)
                    continue
                for b in self._names(f"data/{t}/{v}"):
                    if "=" in b and (t, v, b) not in live:
                        self._fs.delete(self._at(f"data/{t}/{v}/{b}"), True)
