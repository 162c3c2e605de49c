"""A folder of documents, written and read back."""

import os

from pyspark.sql import functions as F

from medlattice.sources.documents import FOLDERS, read_documents, write_documents

ROWS = [("doc-1.md", "one"), ("doc-1.md", "one"), ("doc-2.md", None), (None, "nameless"), (None, "nameless"),
        ("_hidden.md", "kept"), ("a/b c%.md", "größer\nzwei"), ("", "empty name")]


def test_documents_round_trip(spark, tmp_path):
    """Repeated, missing and odd names give what Spark's partitioned writer gives."""
    docs = spark.createDataFrame(ROWS, "document_name string, text string")
    plain = str(tmp_path / "plain")
    docs.repartition("document_name").write.partitionBy("document_name").text(plain)
    write_documents(docs, f"file:{tmp_path}/own")

    def lines(root):
        return sorted((r["document_name"], *sorted(r["text"].split("\n"))) for r in read_documents(spark, root).collect())
    assert lines(f"{tmp_path}/own") == lines(plain)


def test_documents_share_folders(spark, tmp_path):
    """A thousand documents are a thousand files in a bounded number of folders."""
    docs = spark.range(1000).select(F.format_string("doc-%d.md", "id").alias("document_name"), F.col("id").cast("string").alias("text"))
    write_documents(docs, f"file:{tmp_path}")
    held = [files for _, _, files in os.walk(tmp_path)]
    assert sum(map(len, held)) == 1000 and len(held) <= FOLDERS + 1


def test_documents_are_listed_by_tasks(spark, tmp_path):
    """What tasks list and read is what Spark's own reader gives: folders of any depth, hidden and
    odd names, empty files, texts that are no UTF-8, a glob. The driver lists nothing."""
    files = {"a.md": b"one\n", "deep/er/b c%.md": "gr\u00f6\u00dfer".encode(), "deep/_hidden.md": b"no", ".dot/c.md": b"no", "_x/c.md": b"no",
             "name=v%20w/part-0": b"named", "_k=1/d.md": b"partition", "deep/e.txt": b"", "\u00fc #[1].md": b"\xff\xfe", "deep/f.md._COPYING_": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for glob in (None, "*.md", "{a,e}.*", "[b-f]*"):
        reader = spark.read.option("recursiveFileLookup", "true")
        want = (reader.option("pathGlobFilter", glob) if glob else reader).text(str(tmp_path), wholetext=True).select(
            "_metadata.file_path", F.hex(F.col("value").cast("binary"))).collect()
        docs = read_documents(spark, f"file:{tmp_path}", glob)
        assert sorted(map(tuple, docs.select("s3_uri", F.hex(F.col("text").cast("binary"))).collect())) == sorted(map(tuple, want))
        assert docs.inputFiles() == [] and "FileScan" not in docs._jdf.queryExecution().executedPlan().toString()
    assert {r["document_name"] for r in read_documents(spark, f"file:{tmp_path}").collect()} >= {"v%20w", "a.md", "1"}
