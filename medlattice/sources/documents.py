"""A folder (or bucket prefix) of markdown documents, one file each."""

from __future__ import annotations

import os
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 256                       # a folder is listed by one task
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_PLAIN = r"^[A-Za-z0-9][A-Za-z0-9 ._-]*$"


def _mounted(spark: SparkSession, root: str) -> str | None:
    """``root`` as a path that every task can open: a folder of the shared checkpoint storage
    that is mounted as files. None elsewhere (an object store, HDFS)."""
    shared = spark.sparkContext.getCheckpointDir() or ""
    if root.startswith("file:"):
        return "/" + root[len("file:"):].lstrip("/")
    return root if root.startswith("/") and shared.startswith("file:") else None


def write_documents(docs: DataFrame, root: str) -> None:
    """One file per document of ``docs`` (document_name, text) under ``root``, each text with a
    newline after it (NULL: the newline alone); texts of one name share its file, documents
    without a name that of Hive's default name. A name that is no plain file name is given by
    a folder of its own. Where ``root`` is mounted as files, each task
    writes its documents itself, into FOLDERS folders: Spark's writer makes and commits a folder
    for every document, and starts a process for the rights of each file there. A file gets its
    name when it is complete, so a task that runs again replaces what it left."""
    path = _mounted(docs.sparkSession, root)
    if path is None:
        docs.repartition("document_name").write.mode("overwrite").partitionBy("document_name").text(root)
        return

    def write(batches):
        last, out, written = None, None, 0
        for part in batches:
            for folder, name, text in zip(*(part.column(c).to_pylist() for c in ("folder", "document_name", "text"))):
                if (folder, name) != last:
                    if out is not None:
                        out.close()
                        os.replace(f"{into}/.{label}", f"{into}/{label}")
                    last, label = (folder, name), "document.md" if "=" in folder else name
                    into = f"{path}/{folder}"
                    os.makedirs(into, exist_ok=True)
                    out, written = open(f"{into}/.{label}", "wb"), written + 1
                out.write((text or "").encode() + b"\n")
        if out is not None:
            out.close()
            os.replace(f"{into}/.{label}", f"{into}/{label}")
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    name = F.coalesce(F.nullif(F.col("document_name"), F.lit("")), F.lit(_NO_NAME))
    folder = F.when(name.rlike(_PLAIN), F.lpad(F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("string"), 4, "0")).otherwise(
        F.concat(F.lit("document_name="), F.url_encode(name)))
    rows = docs.select(folder.alias("folder"), name.alias("document_name"), "text")
    rows = rows.repartition("document_name").sortWithinPartitions("folder", "document_name")
    rows.mapInArrow(write, "written long").agg(F.sum("written")).first()


#: what a URI quotes in a path (other characters stay, letters outside ASCII too)
_QUOTED = {i: f"%{i:02X}" for i in [*range(33), *map(ord, '"#%<>?[\\]^`{|}'), 127]}


def _files(batches):
    """Partition function: folders or files (path, folder) to the files in them (any depth), by
    the rules of Spark's own listing: names that begin with a dot or an underscore are hidden,
    but for partition folders, files that are being copied too."""
    def hidden(name: str) -> bool:
        return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")

    def walk(path: str):
        with os.scandir(path) as entries:
            for entry in entries:
                if not hidden(entry.name):
                    if entry.is_dir():
                        yield from walk(entry.path)
                    else:
                        yield entry.path
    for batch in batches:
        for path, folder in zip(*(batch.column(c).to_pylist() for c in ("path", "folder"))):
            found = walk(path) if folder else iter([path])
            while some := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file under the mounted folder ``root``, listed in tasks: one looks at the
    folder itself, then every entry in it is walked by one task. Nothing passes through the
    driver, where Spark's own listing keeps some kilobytes a file."""
    def top(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                with os.scandir(root) as entries:
                    own = ((e.path, e.is_dir()) for e in entries if not (e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name)))
                    while some := list(islice(own, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([d for _, d in some], pa.bool_())], names=["path", "folder"])
    entries = spark.range(1, numPartitions=1).mapInArrow(top, "path string, folder boolean")
    return entries.repartition("path").mapInArrow(_files, "path string").repartition("path")


def _whole(batches):
    """Partition function: paths to (path, s3_uri, text), few files and bytes at a time. An empty
    file gives no row, as with Spark's reader."""
    for batch in batches:
        held, size = [], 0
        for path in batch.column("path").to_pylist():
            with open(path, "rb") as f:
                data = f.read()
            if data:
                held.append((path, data))
                size += len(data)
            if size > 1 << 22:
                yield _read(held)
                held, size = [], 0
        if held:
            yield _read(held)


def _read(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array(["file:" + p.translate(_QUOTED) for p, _ in held], pa.string()),
                                       pa.array([t for _, t in held], pa.binary())], names=["path", "s3_uri", "text"])


def read_documents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One row per file under ``root`` (any depth): ``document_name`` (the
    file name, or the value of a ``name=value`` parent folder as Spark's
    partitioned writer lays it out), ``s3_uri`` (full path) and the whole
    ``text``. Files are read whole, never split or truncated. A folder that is mounted as
    files is listed and read by tasks; elsewhere Spark lists it, in the driver."""
    path = _mounted(spark, root)
    if path is not None and os.path.isdir(path):
        files = _listed(spark, os.path.normpath(path))
        if glob:
            pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
            files = files.where(F.substring_index("path", "/", -1).rlike(f"(?s)^(?:{pattern})$"))
        df = files.mapInArrow(_whole, "path string, s3_uri string, text binary").select(
            F.col("text").cast("string").alias("text"), "s3_uri", F.substring_index("path", "/", -1).alias("_file"))
    else:
        reader = spark.read.option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        df = reader.text(root, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("s3_uri"),
                                      F.col("_metadata.file_name").alias("_file"))
    parent = F.regexp_extract("s3_uri", r"/[^/=]+=([^/]+)/[^/]*$", 1)
    name = F.when(parent != "", F.url_decode(parent)).otherwise(F.col("_file"))
    return df.select(name.alias("document_name"), "s3_uri", "text")
