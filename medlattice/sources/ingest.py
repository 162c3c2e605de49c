"""Generic, spec-driven ingest.

Per table: scan CSV as strings -> coerce (lenient casts, NA words, defaults,
fallback columns) -> constraint split (good / quarantine with reasons) ->
first-wins de-duplication -> foreign keys -> write. The reference aborts
the whole load on the first bad row; we keep going and quarantine instead, so
``good + quarantine == input`` always holds.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..session import scratch_path
from .specs import APPEND, COUNTED_TABLES, FIRST_WINS, LOAD_ORDER, SPECS, TableSpec

_SPARK_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(),
                "dbl": T.DoubleType(), "ts": T.TimestampNTZType(), "date": T.DateType(),
                "str": T.StringType(), "bool": T.BooleanType()}


def spark_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(c.name, _SPARK_TYPES[c.kind], True) for c in spec.columns])


def empty_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame([], spark_schema(spec))


# --- S8: module discovery ------------------------------------------------------

_CSV_NAME = re.compile(r"^(?P<table>[A-Za-z_0-9]+)\.csv(?:\.gz)?$")


def discover_sources(spark: SparkSession, root: str) -> DataFrame:
    """List CSV sources under ``root`` at any depth: one row per file with the
    table it belongs to and its module (``hosp``/``icu`` folder, else root).

    A table is a file ``<t>.csv[.gz]`` or a directory ``<t>.csv`` of part files
    (what Spark itself writes). Only file paths are read, never contents.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.csv*").load(root).select("path"))
    seg = F.split(F.col("path"), "/")
    name = F.element_at(seg, -1)
    parent = F.element_at(seg, -2)
    from_file = F.regexp_extract(name, r"^([A-Za-z_0-9]+)\.csv(\.gz)?$", 1)
    from_dir = F.regexp_extract(parent, r"^([A-Za-z_0-9]+)\.csv$", 1)
    table = F.when(from_dir != "", from_dir).otherwise(from_file)
    module_dir = F.when(from_dir != "", F.element_at(seg, -3)).otherwise(parent)
    return files.select(
        "path", table.alias("table"),
        F.when(module_dir.isin("hosp", "icu"), module_dir).otherwise(F.lit("root")).alias("module"),
    ).filter(F.col("table") != "")


def source_paths(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Table -> paths: a CSV file, or the folder of a table written in parts (one row per
    source reaches the driver, not one per part file)."""
    folder = F.regexp_extract("path", r"^(.*\.csv)/[^/]+$", 1)
    sources = discover_sources(spark, root).select("table", F.when(folder != "", folder).otherwise(F.col("path")).alias("path"))
    out: dict[str, list[str]] = {}
    for r in sources.distinct().orderBy("table", "path").collect():
        out.setdefault(r["table"], []).append(r["path"])
    return out


# --- S1 / S7: read -------------------------------------------------------------

def read_csv_strings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as strings, names from the header (no inference)."""
    return (spark.read.option("header", "true").option("inferSchema", "false")
            .option("mode", "PERMISSIVE").option("escape", '"').csv(paths))


def read_source(spark: SparkSession, spec: TableSpec, paths: list[str] | None) -> DataFrame | None:
    """Missing optional file -> ``None`` (the caller uses an empty table);
    missing mandatory file -> error."""
    if not paths:
        if spec.optional:
            return None
        raise FileNotFoundError(f"mandatory source for {spec.name!r} not found")
    return read_csv_strings(spark, paths)


# --- S1–S6: coerce ------------------------------------------------------------

def coerce(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Project the spec's columns from a string frame, with lenient casts.

    S5: a column absent from the file takes ``defaults_if_absent`` (a NULL
    *value* in a present column stays NULL). S6: ``aliases`` picks the first
    present source column. S4: an empty/NA label becomes 'Lab Item {itemid}'.
    """
    present = set(raw.columns)
    for src, dst in spec.renames.items():
        if src in present:
            raw = raw.withColumnRenamed(src, dst)
    present = set(raw.columns)
    out = []
    for c in spec.columns:
        sources = spec.aliases.get(c.name, (c.name,))
        src = next((s for s in sources if s in present), None)
        if src is None:
            default = spec.defaults_if_absent.get(c.name)
            val = F.lit(default).cast(_SPARK_TYPES[c.kind])
        else:
            val = S.lenient_cast(F.col(f"`{src}`"), c.kind)
        out.append(val.alias(c.name))
    df = raw.select(*out)
    if spec.label_default:
        lab = spec.label_default
        df = df.withColumn(lab, F.coalesce(
            F.when(F.col(lab) != "", F.col(lab)),
            F.concat(F.lit("Lab Item "), S.py_str(F.col("itemid")))))
    return df


# --- S12: constraints ---------------------------------------------------------

def violations(spec: TableSpec) -> list[tuple[str, Column]]:
    """(name, violated?) per constraint. A CHECK passes on NULL."""
    out: list[tuple[str, Column]] = []
    for c in spec.columns:
        if not c.nullable:
            out.append((f"{c.name}_not_null", F.col(c.name).isNull()))
        if c.max_len is not None:
            out.append((f"{c.name}_max_len_{c.max_len}",
                        F.coalesce(F.char_length(c.name) > c.max_len, F.lit(False))))
    for name, pred in spec.checks:
        out.append((name, ~F.coalesce(F.expr(pred), F.lit(True))))
    return out


def constraint_split(df: DataFrame, spec: TableSpec, hold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (good, quarantine). Quarantine keeps the row and a comma-joined
    ``reasons`` list; nothing is dropped. ``hold`` writes a frame and reads it back, so that
    what both sides need is made once."""
    checks = violations(spec)
    if not checks:
        df = hold(df) if hold else df
        return df, df.withColumn("reasons", F.lit(None).cast("string")).limit(0)
    reasons = F.concat_ws(",", *[F.when(v, F.lit(n)) for n, v in checks])
    tagged = df.withColumn("reasons", reasons)
    tagged = hold(tagged) if hold else tagged
    good = tagged.filter(F.col("reasons") == "").drop("reasons")
    bad = tagged.filter(F.col("reasons") != "")
    return good, bad


# --- S10: first wins ------------------------------------------------------------

def first_wins(df: DataFrame, key: list[str], order: list[str] | None = None,
               existing: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``INSERT … ON CONFLICT DO NOTHING``: keep the first row per key, within
    the batch and against rows already in the target (``existing`` wins).

    "First" is the smallest row under ``order`` (column names, ascending,
    NULLs last), then all remaining columns, so the choice is total and
    reproducible (CSV line order does not survive a parallel read). Rows
    whose key has a NULL part never conflict and are all kept (N8).

    ``min(struct(...))`` per key has a map-side partial, so a hot key is reduced before
    the shuffle instead of being sorted in one task. Only rows of keys with a rival are
    looked at again for the duplicates. Returns (kept, duplicates).

    With ``hold``, which writes a frame and reads it back, the keys are counted first, without
    the other columns: rows whose key has no rival stay where they are, and only rivals are
    ranked.
    """
    if hold is not None and existing is None:
        null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        keyed = df.filter(~null_key)
        contested = hold(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key))
        kept, losers = first_wins(hold(keyed.join(contested, key, "left_semi").select(*df.columns)), key, order)
        alone = keyed.join(contested, key, "left_anti").select(*df.columns)
        return alone.unionByName(kept).unionByName(df.filter(null_key)), losers
    rest = [c for c in df.columns if c not in key]
    order = [c for c in (order or []) if c in rest]
    ordered = order + [c for c in rest if c not in order]
    whole = F.struct(*[x for i, c in enumerate(ordered) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    keyed = df.filter(~null_key)
    best = keyed.groupBy(*key).agg(F.min(whole).alias("_m"), F.count(F.lit(1)).alias("_n"))
    if existing is not None:
        known = existing.select(*key).dropna().distinct().withColumn("_known", F.lit(True))
        best = best.join(known, key, "left")
    else:
        best = best.withColumn("_known", F.lit(None).cast("boolean"))
    winners = best.where("_known IS NULL").select(*key, *[F.col(f"_m.v{i}").alias(c) for i, c in enumerate(ordered)]).select(*df.columns)
    # of the rows of a key that has more than one, or is known, all but one winner are duplicates
    contested = best.where("_n > 1 OR _known").select(*key, F.col("_m").alias("_best"), F.coalesce("_known", F.lit(False)).alias("_lost"))
    rivals = (keyed.join(contested, key).withColumn("_win", ~F.col("_lost") & whole.eqNullSafe(F.col("_best")))
              .groupBy(*df.columns, "_win").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_c", F.col("_c") - F.when(F.col("_win"), 1).otherwise(0)))
    losers = rivals.select(*df.columns, F.explode(F.when(F.col("_c") > 0, F.sequence(F.lit(1), F.col("_c").cast("int")))
                                                  .otherwise(F.array().cast("array<int>"))).alias("_i")).drop("_i")
    return winners.unionByName(df.filter(null_key)), losers


# --- S13: referential integrity --------------------------------------------------

def referential_check(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Orphans: child rows whose non-null key has no parent (NULL passes)."""
    keys = parent.select(F.col(parent_column).alias(column)).dropna()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def key_orphans(tables: dict[str, DataFrame | None], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """All foreign keys (child, column, parent, parent column) in one pass: one scan per
    table tags its rows' key values, as a child's and as a parent's, and one aggregate (one
    for numbers, one for texts) finds the values that no parent has. Returns (key, value, rows): the key's place in
    ``keys``, the value as text and the child rows that hold it. NULL passes; a parent that
    is not loaded has no rows. A hot value is counted in each task before the shuffle."""
    domains = sorted({(parent, column) for _, _, parent, column in keys})

    def kind(i: int) -> str:
        """What the values of a key are compared as: whole numbers as such, others as text."""
        child, column, parent, parent_column = keys[i]
        types = [tables[t].schema[c].dataType for t, c in ((child, column), (parent, parent_column)) if tables.get(t) is not None]
        return "bigint" if all(isinstance(t, T.IntegralType) for t in types) else "string"
    kinds, found = [kind(i) for i in range(len(keys))], []
    for compared in sorted(set(kinds)):
        of = {d: [i for i, key in enumerate(keys) if key[2:] == d and kinds[i] == compared] for d in domains}
        slots = max(map(len, of.values()))
        tagged = []
        for name, df in tables.items():
            if df is None:
                continue
            roles = [(at, keys[i][1], slot) for at, d in enumerate(domains) for slot, i in enumerate(of[d]) if keys[i][0] == name]
            roles += [(at, d[1], -1) for at, d in enumerate(domains) if d[0] == name and of[d]]
            if roles:
                each = F.array(*[F.struct(F.lit(at).alias("domain"), F.col(column).cast(compared).alias("value"), F.lit(slot).alias("slot")) for at, column, slot in roles])
                tagged.append(df.select(F.inline(each)).where("value IS NOT NULL"))
        if not tagged:
            continue
        # one number a key of the domain, so that the aggregate holds no lists
        rows = [F.count_if(F.col("slot") == slot).alias(f"rows{slot}") for slot in range(slots)]
        values = reduce(DataFrame.unionByName, tagged).groupBy("domain", "value").agg(F.bool_or(F.col("slot") == -1).alias("known"), *rows)
        numbers = F.array(*[F.lit(i) for d in domains for i in of[d] + [-1] * (slots - len(of[d]))])
        each = F.array(*[F.struct(F.get(numbers, F.col("domain") * slots + slot).alias("key"), F.col(f"rows{slot}").alias("rows")) for slot in range(slots)])
        found.append(values.where("NOT known").select(F.col("value").cast("string").alias("value"), F.inline(each)).where("rows > 0").select("key", "value", "rows"))
    return reduce(DataFrame.unionByName, found)


def referential_split(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """(good, orphans) under every foreign key of ``spec``: an orphan keeps its row and
    the names of the keys that no parent row has. A NULL key passes; a parent that is
    not loaded is an empty table. The orphaned values of all keys come from one aggregate;
    the rows themselves meet only these, which are few, so they need no shuffle of their own."""
    if not spec.fks:
        return df, df.withColumn("reasons", F.lit(None).cast("string")).limit(0)
    keys = [(spec.name, column, parent, parent_column) for column, parent, parent_column in spec.fks]
    tables = {parent: parents.get(parent) for _, parent, _ in spec.fks if parent != spec.name}
    orphans = key_orphans({**tables, spec.name: df}, keys)
    aside = scratch_path(df.sparkSession, "orphans")       # found once; their size decides the joins, so few of them leave the table's rows in place
    orphans.write.parquet(aside)
    orphans = df.sparkSession.read.schema(orphans.schema).parquet(aside)
    tagged = df
    for i, (column, _, _) in enumerate(spec.fks):
        lost = orphans.where(F.col("key") == i).select(F.col("value").alias(f"_lost{i}"))
        kind = df.schema[column].dataType
        if isinstance(kind, T.IntegralType):
            tagged = tagged.join(lost.select(F.col(f"_lost{i}").cast(kind).alias(f"_lost{i}")), F.col(column) == F.col(f"_lost{i}"), "left")
        else:
            tagged = tagged.join(lost, F.col(column).cast("string") == F.col(f"_lost{i}"), "left")
    reasons = [F.when(F.col(f"_lost{i}").isNotNull(), F.lit(f"{column}_not_in_{parent}")) for i, (column, parent, _) in enumerate(spec.fks)]
    tagged = tagged.withColumn("reasons", F.concat_ws(",", *reasons)).select(*df.columns, "reasons")
    return tagged.where("reasons = ''").drop("reasons"), tagged.where("reasons <> ''")


# --- S14: table counts -------------------------------------------------------------

def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None],
                 names: list[str] | None = None) -> DataFrame:
    """Row count per table in one job; a table that is not loaded gets NULL."""
    names = names or list(tables)
    parts = []
    for i, n in enumerate(names):
        df = tables.get(n)
        if df is None:
            parts.append(spark.range(1).select(F.lit(i).alias("ordinal"), F.lit(n).alias("table_name"),
                                               F.lit(None).cast("bigint").alias("row_count")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(i).alias("ordinal"), F.lit(n).alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the whole table path -------------------------------------------------------------

@dataclass
class IngestResult:
    good: DataFrame
    quarantine: DataFrame   # typed row + ``reasons``
    loaded: bool = True


def ingest_table(spark: SparkSession, spec: TableSpec, raw: DataFrame | None,
                 existing: DataFrame | None = None, order: list[str] | None = None,
                 hold: Callable[[DataFrame], DataFrame] | None = None) -> IngestResult:
    """Coerce -> constraints -> first wins (or append). ``hold`` writes a frame and reads
    it back: the source is then read once, for good and quarantined rows."""
    if raw is None:
        e = empty_table(spark, spec)
        return IngestResult(e, e.withColumn("reasons", F.lit(None).cast("string")), loaded=False)
    typed = coerce(raw, spec)
    good, bad = constraint_split(typed, spec, hold)
    if spec.policy == FIRST_WINS and spec.key:
        good, dups = first_wins(good, list(spec.key), order, existing, hold)
        bad = bad.unionByName(dups.withColumn("reasons", F.lit("duplicate_key")))
    return IngestResult(good, bad)


MANIFEST = "current.json"


def published(spark: SparkSession, out_dir: str) -> str | None:
    """Folder of the last load that was finished, None before the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_dir, MANIFEST)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return f"{out_dir}/{spark.read.schema('run string').json(path.toString()).first()['run']}"


def publish(spark: SparkSession, out_dir: str, run: str) -> None:
    """Switch the manifest to a load's folder: written aside, then renamed over the old one,
    so a reader sees the old load or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(out_dir, MANIFEST), jvm.org.apache.hadoop.fs.Path(out_dir, f"_{MANIFEST}.{run}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(f'{{"run": "{run}"}}', "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(target), overwrite)


def load_all(spark: SparkSession, root: str, out_dir: str) -> DataFrame:
    """3B: discover, ingest every table, parents first, split off the rows whose foreign
    keys have no parent, and write good and quarantine rows aside in a folder of this
    load. Only when every table is there the load is published, so a load that fails or is
    repeated leaves the last good one as it is. Counts all 26 tables."""
    paths = source_paths(spark, root)
    run = f"load-{uuid.uuid4().hex[:12]}"
    base, written = f"{out_dir}/{run}", {}
    for name in LOAD_ORDER:
        spec = SPECS[name]
        places = (f"{base}/_checked/{name}-{i}" for i in count())

        def hold(df: DataFrame) -> DataFrame:
            path = next(places)
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        # typed, checked and counted by key once; the key check and both writes read that
        res = ingest_table(spark, spec, read_source(spark, spec, paths.get(name)), hold=hold)
        if not res.loaded:
            written[name] = None
            continue
        good, orphans = referential_split(res.good, spec, written)
        good.write.parquet(f"{base}/{name}")
        res.quarantine.unionByName(orphans).write.parquet(f"{base}/_quarantine/{name}")
        written[name] = spark.read.schema(spark_schema(spec)).parquet(f"{base}/{name}")
    publish(spark, out_dir, run)
    return table_counts(spark, written, COUNTED_TABLES)


def load_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """(table_name, reasons, row_count) of the published load: good rows under the empty
    reason, the quarantined by reason."""
    base = published(spark, out_dir)
    if base is None:
        raise FileNotFoundError(f"no finished load in {out_dir}")
    parts = []
    for name in LOAD_ORDER:
        for folder, reason in ((f"{base}/{name}", F.lit("")), (f"{base}/_quarantine/{name}", F.col("reasons"))):
            schema = spark_schema(SPECS[name]) if folder.endswith(f"{base}/{name}") else T.StructType([*spark_schema(SPECS[name]).fields, T.StructField("reasons", T.StringType())])
            try:
                parts.append(spark.read.schema(schema).parquet(folder).select(F.lit(name).alias("table_name"), reason.alias("reasons")))
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "reasons").agg(F.count(F.lit(1)).alias("row_count"))


# --- S20 / S21 ---------------------------------------------------------------------------

def read_subject_list(spark: SparkSession, path: str) -> DataFrame:
    """One-column CSV of subject ids."""
    raw = read_csv_strings(spark, [path])
    return raw.select(S.lenient_cast(F.col(raw.columns[0]), "long").alias("subject_id")).dropna()


def restrict_to_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Semi-join on the list; Spark broadcasts it when its size estimate is small."""
    return df.join(subjects.select(F.col("subject_id").alias(key)).distinct(), key, "left_semi")


def read_relational(spark: SparkSession, url: str, table: str, partition_column: str,
                    lower: int, upper: int, num_partitions: int, properties: dict[str, str]) -> DataFrame:
    """Partitioned JDBC read (the drop-in for the reference's database
    reads). Not exercised offline: no database is available here."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties)


__all__ = ["APPEND", "FIRST_WINS", "SPECS", "IngestResult", "coerce", "constraint_split",
           "discover_sources", "empty_table", "first_wins", "ingest_table", "key_orphans", "load_all", "load_report", "publish", "published", "read_csv_strings",
           "read_relational", "read_source", "read_subject_list", "referential_check", "referential_split",
           "restrict_to_subjects", "source_paths", "spark_schema", "table_counts"]
