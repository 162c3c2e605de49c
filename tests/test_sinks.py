"""What the sinks leave on disk."""

import os
import time

from pyspark.sql import functions as F

from medlattice.sources import sinks


def test_a_sink_leaves_no_shuffle_files(spark, tmp_path):
    """The files of a step's shuffle go when it is done; the table is compressed with zstd and holds each key once."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> int:
        return sum(block.startswith("shuffle_") for block in disk.getAllBlocks().mkString("\n").split("\n"))
    rows = spark.range(5000).select((F.col("id") % 4000).alias("query_id"), F.lit(0).alias("citation_pos"), F.lit(0).alias("reference_pos"),
                                    F.timestamp_add("DAY", (F.col("id") % 4000 % 3).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"))
    before, cleaned = shuffles(), spark.conf.get(sinks._CLEAN, "false")
    for _ in range(2):
        out = sinks.citation_sink(spark, rows, str(tmp_path / "table"))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and spark.conf.get(sinks._CLEAN, "false") == cleaned
    files = [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    assert out.count() == out.select("citation_key").distinct().count() == 4000
