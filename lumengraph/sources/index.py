"""The index of a vault: documents, chunks with vectors, and links as versioned tables, built whole, by differences, or for some
paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import embedding
from lumengraph.operators import changes
from lumengraph.sources import scratch, vault
from lumengraph.sources.store import VersionedTable


class VaultIndex:
    """Tables below ``path`` of the notes below ``root``."""

    def __init__(self, spark: SparkSession, root: str, path: str, embed: embedding.Embedder | None = None, excluded: Sequence[str] = ()):
        self.spark, self.root, self.excluded = spark, root.rstrip("/"), list(excluded)
        self.embed = embed or embedding.hashed_words()
        self.documents, self.chunks, self.links = (VersionedTable(spark, f"{path.rstrip('/')}/{n}", k) for n, k in (("documents", ["source_file"]), ("chunks", ["note_path", "chunk_index"]), ("links", ["src", "dst"])))

    def _present(self) -> DataFrame:
        return vault.documents(vault.scan(self.spark, self.root, self.excluded))

    def _refresh_links(self) -> None:
        """Links of all notes anew, as a note that comes or goes may change what others' links mean."""
        chunks = self.chunks.read()
        if chunks is not None:
            self.links.overwrite(vault.resolved_links(chunks, vault.scan_all(self.spark, self.root)))

    def full(self) -> None:
        docs = scratch.materialized(self._present())
        self.documents.overwrite(docs)
        self.chunks.overwrite(vault.chunks(docs, self.embed))
        self._refresh_links()

    def incremental(self) -> DataFrame:
        """(source_file, change) of what differs from the stored hashes, applied."""
        stored = self.documents.read()
        if stored is None:
            self.full()
            return self.documents.read().select("source_file", F.lit("added").alias("change"))
        now = scratch.materialized(self._present())
        found = scratch.materialized(changes.detect(stored, now))
        self._apply(now, found.filter("change <> 'deleted'").select("source_file"), found.filter("change <> 'added'").select("source_file"))
        return found

    def reindex(self, paths: Sequence[str]) -> DataFrame:
        """(source_file, action) for files and folders, gone ones included, applied."""
        now = scratch.materialized(self._present())
        stored = self.documents.read()
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        plan = scratch.materialized(changes.reindex_plan(now.limit(0) if stored is None else stored, now, asked))
        self._apply(now, plan.filter("action = 'reindex'").select("source_file"), plan.select("source_file"))
        return plan

    def _apply(self, now: DataFrame, fresh: DataFrame, gone: DataFrame) -> None:
        """Rows of ``gone`` notes leave, those of ``fresh`` ones come."""
        docs = now.join(fresh, "source_file", "left_semi")
        old, parts = self.documents.read(), self.chunks.read()
        chunks = vault.chunks(docs, self.embed)
        self.documents.overwrite(docs if old is None else changes.replace_chunks(old, docs, gone, "source_file"))
        self.chunks.overwrite(chunks if parts is None else changes.replace_chunks(parts, chunks, gone.withColumnRenamed("source_file", "note_path")))
        self._refresh_links()

    def stats(self) -> DataFrame:
        """(documents, chunks, links, last_indexed): counts, and when the documents were last written."""
        docs, parts, links = self.documents.read(), self.chunks.read(), self.links.read()
        none = self.spark.range(0)
        one = (none if docs is None else docs).agg(F.count("*").alias("documents"))
        two = (none if parts is None else parts).agg(F.count("*").alias("chunks"))
        three = (none if links is None else links).agg(F.count("*").alias("links"))
        return one.join(two).join(three).withColumn("last_indexed", F.lit(self.documents.written()))  # one row each
