"""A folder of Markdown notes as a DataFrame, and notes as documents, chunks and links."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import embedding, markdown, text


def _nfc(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: unicodedata.normalize("NFC", p))


def _listed(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(relative path, whole path, bytes) of every file below ``root``, hidden ones too, as the driver's listing has them."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, files, out = fs.makeQualified(top).toString().rstrip("/") + "/", fs.listFiles(top, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString().removeprefix(base), f.getPath().toString(), f.getLen()))
    return out


def _rule(line: str, folder: str) -> tuple[re.Pattern, bool] | None:
    """A line of an ignore file in a folder: what it matches, and whether it takes paths back in."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    only_folders, bare = line.endswith("/"), line.strip("/")
    anchored = "/" in line.rstrip("/")
    body, i = "", 0
    while i < len(bare):
        if bare.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif bare.startswith("**", i):
            body, i = body + ".*", i + 2
        else:
            c = bare[i]
            body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]" else re.escape(c)), i + 1
    lead = re.escape(f"{folder}/" if folder else "") + ("" if anchored else "(?:.*/)?")
    return re.compile(f"{lead}{body}{'/.+' if only_folders else '(?:/.+)?'}"), back


def ignored(paths: Sequence[str], rules: Sequence[tuple[re.Pattern, bool]]) -> list[bool]:
    """Whether the last rule that matches a path, or a folder above it, ignores it."""

    def one(path: str) -> bool:
        out = False
        for pattern, back in rules:
            if pattern.fullmatch(path):
                out = not back
        return out

    return [one(p) for p in paths]


def walk(spark: SparkSession, root: str, excluded: Sequence[str] = (), standard: bool = True) -> DataFrame:
    """(path, is_dir, file) of the notes below ``root`` and the folders above them. ``excluded``: folder names left out at any depth;
    ``standard``: hidden files and folders, and what .gitignore files name, are left out too."""
    files = _listed(spark, root.rstrip("/"))
    rules = []
    if standard:
        read = spark._jvm.org.apache.commons.io.IOUtils
        for rel, whole, _ in sorted(f for f in files if f[0].rsplit("/", 1)[-1] == ".gitignore"):
            p = spark._jvm.org.apache.hadoop.fs.Path(whole)
            stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
            lines = read.toString(stream, "UTF-8").splitlines()
            stream.close()
            rules += [r for r in (_rule(x, rel.rpartition("/")[0]) for x in lines) if r]
    notes = [f for f in files if f[0].endswith(".md") and not set(f[0].split("/")[:-1]) & set(excluded)]
    if standard:
        notes = [f for f in notes if not any(part.startswith(".") for part in f[0].split("/"))]
        notes = [f for f, out in zip(notes, ignored([f[0] for f in notes], rules), strict=True) if not out]
    nfc = {f[0]: unicodedata.normalize("NFC", f[0]) for f in notes}
    folders = {"/".join(p.split("/")[:i]) for p in nfc.values() for i in range(1, p.count("/") + 1)}
    rows = [(p, True, None) for p in sorted(folders)] + [(nfc[rel], False, whole) for rel, whole, _ in notes]
    return spark.createDataFrame(rows, "path string, is_dir boolean, file string")


def scan(spark: SparkSession, root: str, excluded: Sequence[str] = (), standard: bool = True) -> DataFrame:
    """(path, content, file_mtime) of the notes that ``walk`` finds; paths are relative and NFC."""
    found = walk(spark, root, excluded, standard).filter("NOT is_dir")
    files = [(r.path, r.file) for r in found.select("path", "file").collect()]  # the listing, as Spark's own readers hold it
    plain = [f for p, f in files if "/_" not in f"/{p}"]
    out = _read_marked(found.filter(F.contains(F.concat(F.lit("/"), "path"), F.lit("/_"))))
    return _read(spark, root, plain).union(out) if plain else out


def scan_all(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every note, whatever is excluded or ignored: what links resolve against."""
    return walk(spark, root, standard=False).filter("NOT is_dir").select("path")


def _read(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    rows = spark.read.text(files, wholetext=True)
    rows = rows.select(F.url_decode("_metadata.file_path").alias("full"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("file_mtime"))
    tail = unquote(root.rstrip("/").split("://")[-1]).lstrip("/").replace("'", "\\'")
    rows = rows.select(F.expr(f"substr(full, locate('{tail}/', full) + {len(tail) + 1})").alias("path"), "content", "file_mtime")
    return rows.select(F.pandas_udf(_nfc, "string")("path").alias("path"), "content", "file_mtime")


def _read_marked(files: DataFrame) -> DataFrame:
    """As ``_read``, of names with a leading underscore, which Spark's readers pass over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(uri, safe="/:")))
                with store.open_input_file(at) as f:
                    rows.append((path, f.read().decode(errors="replace"), store.get_file_info(at).mtime))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "content", "file_mtime"])

    return files.select("path", "file").mapInArrow(run, "path string, content string, file_mtime timestamp")


def paths_below(notes: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """(path) below a folder, ascending."""
    return notes.filter(F.startswith(F.col(path), F.lit(folder.rstrip("/") + "/"))).select(path).distinct().orderBy(path)


def documents(notes: DataFrame) -> DataFrame:
    """source_file, full_text (body), title, tags, content_hash, file_mtime, last_modified (a date of the frontmatter, else the
    file's) of scanned notes."""
    front = text.frontmatter(F.col("content"))
    seconds = F.unix_timestamp("file_mtime").cast("double")
    return notes.select(
        F.col("path").alias("source_file"),
        text.body(F.col("content")).alias("full_text"),
        text.title(text.body(F.col("content")), F.col("path")).alias("title"),
        F.coalesce(text.tags(front), F.array().cast("array<string>")).alias("tags"),
        F.sha2("content", 256).alias("content_hash"),
        seconds.alias("file_mtime"),
        F.coalesce(text.date_field(front, "modified"), text.date_field(front, "created"), seconds).alias("last_modified"),
    )


def chunks(docs: DataFrame, embed: embedding.Embedder | None = None) -> DataFrame:
    """note_path, chunk_index, breadcrumb, content, links of documents; with an embedder also ``vector``."""
    c = F.explode(markdown.chunk_column(F.col("full_text"), F.col("source_file"))).alias("c")
    out = docs.select(F.col("source_file").alias("note_path"), c).select("note_path", "c.*")
    if embed is None:
        return out
    return embedding.embedded(out.withColumn("embed_text", embedding.embed_text(F.col("breadcrumb"), F.col("content"))), embed).drop("embed_text")


def by_stem(paths: DataFrame, path: str = "path") -> DataFrame:
    """(stem, dst): of equal stems the path of fewest bytes, then the least, counts."""
    stem: Column = F.regexp_extract(path, "([^/]+)[.]md$", 1)
    return paths.select(stem.alias("stem"), F.col(path).alias("p")).groupBy("stem").agg(F.min_by("p", F.struct(F.octet_length("p"), "p")).alias("dst"))


def resolved_links(parts: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst) of the links in chunks, by file stem among all ``paths`` (path)."""
    out = parts.select(F.col("note_path").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("stem"))
    return out.join(by_stem(paths), "stem").select("src", "dst").distinct()
