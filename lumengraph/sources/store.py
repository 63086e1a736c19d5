"""A keyed table as Parquet files in versions: a write replaces the buckets of key hashes that it touches."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import changes

#: Buckets of a table.
BUCKETS = 16


class VersionedTable:
    """``path``/v<n> holds what version n wrote, a folder for each bucket; its manifest, written last, says for every bucket which version
    has it. Readers see whole versions; ``vacuum`` keeps what the newest manifests name."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Those written to their end."""
        fs, p = self._at()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("manifest") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        fs, p = self._at(f"manifest{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def written(self) -> float | None:
        """Epoch seconds at which the newest version was."""
        v = self.versions()
        if not v:
            return None
        fs, p = self._at(f"manifest{v[-1]}.json")
        return fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The newest version, or some buckets of it."""
        v = self.versions()
        if not v:
            return None
        m = self._manifest(v[-1])
        held = {int(b): at for b, at in m["buckets"].items() if buckets is None or int(b) in buckets}
        schema = self.spark.createDataFrame([], m["schema"]).schema
        paths = [f"{self.path}/v{at}/bucket={b}" for b, at in held.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kept: dict[str, int]) -> int:
        v = (self.versions() or [0])[-1] + 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        dealt = rows.withColumn("bucket", self._bucket())
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{v}")
        fs, p = self._at(f"v{v}")
        own = {s.getPath().getName()[7:]: v for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        fs, p = self._at(f"manifest{v}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"schema": schema, "buckets": kept | own}), "utf-8"))
        out.close()
        return v

    def overwrite(self, rows: DataFrame) -> int:
        return self._write(rows, {})

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``

    def _replace(self, keys: DataFrame, change) -> int:
        """``change`` of the rows in the buckets of ``keys``."""
        touched = self._touched(keys)
        kept = {b: at for b, at in self._manifest(self.versions()[-1])["buckets"].items() if int(b) not in touched}
        return self._write(change(self.read(touched)), kept)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows by key; with ``order``, of a key's rows, stored and new, that of its greatest value stays. A table of another schema is
        replaced."""

        def latest(every: DataFrame) -> DataFrame:
            return every.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")

        old = self.read([])
        if old is None or dict(old.dtypes) != dict(rows.dtypes):
            return self.overwrite(rows if order is None else latest(rows))
        return self._replace(rows, lambda own: changes.merge(own, rows, self.keys) if order is None else latest(own.unionByName(rows)))

    def delete(self, gone: DataFrame, key: str) -> int | None:
        """Rows of these values of a column go; the whole key's column needs only its own buckets rewritten."""
        if self.read([]) is None:
            return None
        if self.keys == [key]:
            return self._replace(gone, lambda own: changes.delete(own, gone, key))
        return self.overwrite(changes.delete(self.read(), gone, key))

    def vacuum(self, keep: int = 2) -> None:
        """Older versions go, but for buckets that a kept one names."""
        versions = self.versions()
        used = {(int(b), at) for v in versions[-keep:] for b, at in self._manifest(v)["buckets"].items()}
        for v in versions[:-keep]:
            fs, p = self._at(f"manifest{v}.json")
            fs.delete(p, False)
        fs, p = self._at()
        for folder in fs.listStatus(p):
            name = folder.getPath().getName()
            if not name.startswith("v") or int(name[1:]) > versions[-1]:
                continue
            own = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            stale = [q for q in own if (int(q.getName()[7:]), int(name[1:])) not in used]
            for q in stale:
                fs.delete(q, True)
            if len(stale) == len(own) and int(name[1:]) not in versions[-keep:]:
                fs.delete(folder.getPath(), True)
