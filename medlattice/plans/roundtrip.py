"""Ingest, sink and citation operators bound to the driver's tables.

Ingest queries write derived CSV/JSON/Parquet to a scratch folder on the
shared checkpoint storage, run the operator, and read the result back; the
oracle computes the same rows directly from the source tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import querylog
from ..operators.scan import dense_rank_all
from ..session import scratch_path
from ..sources import ingest as I
from ..sources import sinks
from ..sources.specs import LOAD_ORDER, SPECS
from .bindings import ClinicalTables, with_ctes
from .catalog import register

_TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", "true").option("timestampNTZFormat", _TS_FMT)
     .option("timestampFormat", _TS_FMT).csv(path))


def _admissions_raw(t: ClinicalTables) -> DataFrame:
    """admissions.csv as the hospital would export it: strings, some bad values."""
    a = t.admissions
    return a.select(
        F.col("hadm_id").cast("string").alias("hadm_id"),
        F.col("subject_id").cast("string").alias("subject_id"),
        F.date_format("admittime", _TS_FMT).alias("admittime"),
        F.date_format("dischtime", _TS_FMT).alias("dischtime"),
        "admission_type", "admission_location", "discharge_location", "insurance",
        F.when(F.col("admission_location") == "F", "1").when(F.col("admission_location") == "O", "0")
        .when(F.col("admission_type") == "5-LOW", "NA").otherwise("2").alias("hospital_expire_flag"),
    )


def _ingested_admissions(spark: SparkSession, sf_dir: str) -> I.IngestResult:
    t = ClinicalTables(spark, sf_dir)
    root = scratch_path(spark, "ingest")
    _write_csv(_admissions_raw(t), f"{root}/export/hosp/admissions.csv")
    paths = I.source_paths(spark, root)
    spec = SPECS["admissions"]
    return I.ingest_table(spark, spec, I.read_source(spark, spec, paths.get("admissions")))


_ADM_ORACLE = """SELECT CAST(hadm_id AS INTEGER) AS hadm_id, CAST(subject_id AS INTEGER) AS subject_id,
  admittime, dischtime, admission_type, admission_location, discharge_location, insurance,
  CAST(CASE WHEN admission_location = 'F' THEN 1 WHEN admission_location = 'O' THEN 0
       WHEN admission_type = '5-LOW' THEN NULL ELSE 2 END AS SMALLINT) AS hospital_expire_flag
  FROM admissions"""


@register("ingest_table", with_ctes("""
SELECT hadm_id, subject_id, admittime, dischtime, admission_type, admission_location, discharge_location,
  insurance, hospital_expire_flag FROM typed
WHERE coalesce(hospital_expire_flag IN (0, 1), true) AND coalesce(dischtime >= admittime, true)""",
    "admissions", extra=(("typed", _ADM_ORACLE),)))
def q_ingest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _ingested_admissions(spark, sf_dir)
    return res.good.select("hadm_id", "subject_id", "admittime", "dischtime", "admission_type",
                           "admission_location", "discharge_location", "insurance", "hospital_expire_flag")


@register("constraint_check", with_ctes("""
SELECT hadm_id, concat_ws(',',
  CASE WHEN NOT coalesce(hospital_expire_flag IN (0, 1), true) THEN 'hospital_expire_flag_0_1' END,
  CASE WHEN NOT coalesce(dischtime >= admittime, true) THEN 'dischtime_after_admittime' END) AS reasons
FROM typed
WHERE NOT (coalesce(hospital_expire_flag IN (0, 1), true) AND coalesce(dischtime >= admittime, true))""",
    "admissions", extra=(("typed", _ADM_ORACLE),)))
def q_constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested_admissions(spark, sf_dir).quarantine.select("hadm_id", "reasons")


@register("lenient_cast", """
SELECT event_id, CAST(trunc(TRY_CAST(s_int AS DOUBLE)) AS INTEGER) AS as_int,
  TRY_CAST(s_dbl AS DOUBLE) AS as_dbl, TRY_CAST(s_ts AS TIMESTAMP) AS as_ts
FROM (SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN CAST(value AS VARCHAR)
       ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS s_int,
  CASE WHEN event_type = 'signup' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS s_dbl,
  CASE WHEN event_type = 'purchase' THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s_ts
  FROM events) r""")
def q_lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ClinicalTables(spark, sf_dir).raw("events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", F.col("value").cast("string"))
        .otherwise(F.get_json_object("props", "$.k")).alias("s_int"),
        F.when(F.col("event_type") == "signup", "bad").otherwise(F.col("value").cast("string")).alias("s_dbl"),
        F.when(F.col("event_type") == "purchase", "not a date").otherwise(F.date_format("ts", _TS_FMT)).alias("s_ts"))
    return raw.select("event_id", S.lenient_cast("s_int", "int").alias("as_int"),
                      S.lenient_cast("s_dbl", "dbl").alias("as_dbl"), S.lenient_cast("s_ts", "ts").alias("as_ts"))


_NA_SQL = ", ".join("'" + w + "'" for w in S.PANDAS_NA_WORDS)


@register("na_normalize", f"""
SELECT event_id, raw, CASE WHEN raw IN ({_NA_SQL}) THEN NULL ELSE raw END AS normalized
FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'NA' WHEN event_type = 'view' THEN ' None '
  WHEN event_type = 'error' THEN '' WHEN event_type = 'signup' THEN 'null' ELSE 'ok-' || CAST(event_id AS VARCHAR) END
  AS raw FROM events) r""")
def q_na_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ClinicalTables(spark, sf_dir).raw("events")
    et = F.col("event_type")
    raw = e.select("event_id", F.when(et == "click", "NA").when(et == "view", " None ").when(et == "error", "")
                   .when(et == "signup", "null").otherwise(F.concat(F.lit("ok-"), F.col("event_id").cast("string")))
                   .alias("raw"))
    return raw.select("event_id", "raw", S.na_normalize("raw").alias("normalized"))


@register("default_label", f"""
SELECT CAST(p_partkey AS INTEGER) AS itemid,
  CASE WHEN raw_label IS NULL OR raw_label IN ({_NA_SQL}) THEN 'Lab Item ' || CAST(p_partkey AS VARCHAR)
       ELSE raw_label END AS label,
  p_brand AS fluid, p_type AS category
FROM (SELECT *, CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN 'NA' ELSE p_name END AS raw_label
      FROM part) p""")
def q_default_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ClinicalTables(spark, sf_dir).raw("part")
    raw = p.select(
        F.col("p_partkey").cast("string").alias("itemid"),
        F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 == 1, "NA").otherwise(F.col("p_name"))
        .alias("label"),
        F.col("p_brand").alias("fluid"), F.col("p_type").alias("category"))
    return I.coerce(raw, SPECS["d_labitems"]).select("itemid", "label", "fluid", "category")


@register("default_icd_version", """
SELECT CAST(s_suppkey AS VARCHAR) AS icd_code, 10 AS icd_version, s_name || ' procedure' AS long_title
FROM supplier""")
def q_default_icd_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ClinicalTables(spark, sf_dir).raw("supplier")
    raw = s.select(F.col("s_suppkey").cast("string").alias("icd_code"),
                   F.concat(F.col("s_name"), F.lit(" procedure")).alias("long_title"))
    return I.coerce(raw, SPECS["d_icd_procedures"]).select("icd_code", "icd_version", "long_title")


@register("column_fallback", """
SELECT CAST(o_orderkey AS INTEGER) AS hadm_id, o_orderpriority AS race FROM orders""")
def q_column_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ClinicalTables(spark, sf_dir).raw("orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("hadm_id"),
                   F.col("o_custkey").cast("string").alias("subject_id"),
                   F.date_format("o_orderdate", _TS_FMT).alias("admittime"),
                   F.col("o_orderpriority").alias("ethnicity"))
    return I.coerce(raw, SPECS["admissions"]).select("hadm_id", "race")


@register("insert_first_wins", with_ctes("""
SELECT subject_id, hadm_id, seq_num, icd_code, icd_version FROM (
  SELECT *, row_number() OVER (PARTITION BY hadm_id, seq_num
    ORDER BY icd_code ASC NULLS LAST, icd_version ASC NULLS LAST, subject_id ASC NULLS LAST) AS rn
  FROM dx) d
WHERE hadm_id IS NULL OR seq_num IS NULL
   OR (rn = 1 AND NOT (hadm_id % 10 = 0 AND seq_num = 1))""", "diagnoses_icd", extra=(
    ("dx", """SELECT subject_id, CASE WHEN hadm_id % 17 = 0 THEN NULL ELSE hadm_id // 2 END AS hadm_id,
        CASE WHEN hadm_id % 19 = 0 THEN NULL ELSE seq_num END AS seq_num, icd_code, icd_version FROM diagnoses_icd"""),)))
def q_insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses with repeated and NULL keys against a target that already holds the
    first diagnosis of every tenth admission."""
    t = ClinicalTables(spark, sf_dir)
    dx = t.diagnoses_icd.select(
        "subject_id", F.when(F.col("hadm_id") % 17 != 0, F.expr("hadm_id div 2")).alias("hadm_id"),
        F.when(F.col("hadm_id") % 19 != 0, F.col("seq_num")).alias("seq_num"), "icd_code", "icd_version")
    target = dx.where("hadm_id % 10 = 0 AND seq_num = 1")
    kept, _ = I.first_wins(dx, ["hadm_id", "seq_num"], order=["icd_code", "icd_version"], existing=target)
    return kept


@register("referential_check", with_ctes("""
SELECT subject_id, hadm_id, stay_id, itemid, charttime FROM chartevents c
WHERE stay_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM icustays i WHERE i.stay_id = c.stay_id)""",
    "chartevents", "icustays"))
def q_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    ce = t.chartevents.select("subject_id", "hadm_id", "stay_id", "itemid", "charttime")
    return I.referential_check(ce, "stay_id", t.icustays, "stay_id")


_BOUND_TABLES = ["patients", "admissions", "diagnoses_icd", "d_icd_diagnoses", "procedures_icd",
                 "d_icd_procedures", "labevents", "d_labitems", "prescriptions", "emar", "poe", "drgcodes",
                 "icustays", "d_items", "chartevents", "inputevents"]


def _bound_keys() -> list[tuple[str, str, str, str]]:
    """(child, column, parent, parent column) of every declared foreign key both of whose
    tables are bound (drgcodes has no subject_id there)."""
    return [(child, column, parent, parent_column) for child in _BOUND_TABLES for column, parent, parent_column in SPECS[child].fks
            if parent in _BOUND_TABLES and (child, column) not in _ABSENT]


_ABSENT = {("drgcodes", "subject_id"), ("emar", "hadm_id")}


def _foreign_keys_sql() -> str:
    each = [f"""SELECT '{c}' AS table_name, '{k}' AS key_column, '{p}' AS parent,
      (SELECT count(*) FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS orphans"""
            for c, k, p, pk in _bound_keys()]
    return with_ctes(" UNION ALL ".join(each), *_BOUND_TABLES)


@register("foreign_keys", _foreign_keys_sql())
def q_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans under every bound foreign key, from one scan of each table."""
    t, keys = ClinicalTables(spark, sf_dir), _bound_keys()
    t.bind_events_once()
    names = {c for c, *_ in keys} | {p for _, _, p, _ in keys}
    lost = I.key_orphans({n: getattr(t, n) for n in sorted(names)}, keys).groupBy("key").agg(F.sum("rows").alias("orphans"))
    listed = spark.createDataFrame([(i, c, k, p) for i, (c, k, p, _) in enumerate(keys)], "key int, table_name string, key_column string, parent string")
    return listed.join(lost, "key", "left").select("table_name", "key_column", "parent", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def _table_counts_sql() -> str:
    from ..sources.specs import COUNTED_TABLES
    parts = []
    for i, n in enumerate(COUNTED_TABLES):
        cnt = f"(SELECT count(*) FROM {n})" if n in _BOUND_TABLES else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT {i} AS ordinal, '{n}' AS table_name, {cnt} AS row_count")
    return with_ctes(" UNION ALL ".join(parts), *_BOUND_TABLES)


@register("table_counts", _table_counts_sql())
def q_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.specs import COUNTED_TABLES
    t = ClinicalTables(spark, sf_dir)
    t.bind_events_once()
    tables = {n: getattr(t, n) for n in _BOUND_TABLES}
    return I.table_counts(spark, tables, COUNTED_TABLES)


def _patients_raw(t: ClinicalTables) -> DataFrame:
    p = t.patients
    return p.select(F.col("subject_id").cast("string").alias("subject_id"), "gender",
                    F.col("anchor_age").cast("string").alias("anchor_age"), "anchor_year_group",
                    F.date_format("dod", "yyyy-MM-dd").alias("dod"))


@register("module_discovery", with_ctes("""
SELECT CAST(subject_id AS INTEGER) AS subject_id, gender, anchor_age, anchor_year_group,
  CAST(dod AS TIMESTAMP) AS dod, 'hosp' AS module
FROM patients""", "patients"))
def q_module_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources two folders deep are found by listing, not by a fixed path."""
    t = ClinicalTables(spark, sf_dir)
    root = scratch_path(spark, "discover")
    _write_csv(_patients_raw(t), f"{root}/export/2.2/hosp/patients.csv")
    listing = I.discover_sources(spark, root).filter(F.col("table") == "patients")
    modules = sorted({r["module"] for r in listing.select("module").distinct().collect()})
    paths = I.source_paths(spark, root)
    spec = SPECS["patients"]
    good = I.ingest_table(spark, spec, I.read_source(spark, spec, paths.get("patients"))).good
    return good.select("subject_id", "gender", "anchor_age", "anchor_year_group",
                       F.col("dod").cast("timestamp_ntz").alias("dod"), F.lit(",".join(modules)).alias("module"))


@register("optional_source", with_ctes("""
SELECT 0 AS ordinal, 'patients' AS table_name, (SELECT count(*) FROM patients) AS row_count
UNION ALL SELECT 1, 'admissions', (SELECT count(*) FROM admissions)
UNION ALL SELECT 2, 'transfers', CAST(NULL AS BIGINT)""", "patients", "admissions"))
def q_optional_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory tables present, optional ``transfers`` missing: it is reported
    as not loaded (NULL count) instead of failing the load."""
    t = ClinicalTables(spark, sf_dir)
    root = scratch_path(spark, "optional")
    _write_csv(_patients_raw(t), f"{root}/hosp/patients.csv")
    adm = _admissions_raw(t).withColumn("hospital_expire_flag", F.lit(None).cast("string"))
    _write_csv(adm.withColumn("dischtime", F.lit(None).cast("string")), f"{root}/hosp/admissions.csv")
    paths = I.source_paths(spark, root)
    loaded = {}
    for name in ["patients", "admissions", "transfers"]:
        spec = SPECS[name]
        res = I.ingest_table(spark, spec, I.read_source(spark, spec, paths.get(name)))
        loaded[name] = res.good if res.loaded else None
    return I.table_counts(spark, loaded, ["patients", "admissions", "transfers"])


@register("insert_append", """
SELECT CAST(o_custkey AS INTEGER) AS subject_id, CAST(o_orderkey AS INTEGER) AS hadm_id,
  CAST(o_orderkey AS INTEGER) AS transfer_id_orig, 'admit' AS eventtype, o_orderpriority AS careunit,
  o_orderdate AS intime
FROM orders""")
def q_insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transfers`` has a surrogate key: the reference duplicates rows on a
    rerun. We overwrite the table, so loading twice leaves one copy."""
    o = ClinicalTables(spark, sf_dir).raw("orders")
    raw = o.select(F.col("o_custkey").cast("string").alias("subject_id"),
                   F.col("o_orderkey").cast("string").alias("hadm_id"),
                   F.col("o_orderkey").cast("string").alias("transfer_id"),
                   F.lit("admit").alias("eventtype"), F.col("o_orderpriority").alias("careunit"),
                   F.date_format("o_orderdate", _TS_FMT).alias("intime"))
    root = scratch_path(spark, "append")
    spec = SPECS["transfers"]
    for _ in range(2):  # a rerun
        I.ingest_table(spark, spec, raw).good.write.mode("overwrite").parquet(f"{root}/transfers")
    back = spark.read.parquet(f"{root}/transfers")
    return back.select("subject_id", "hadm_id", "transfer_id_orig", "eventtype", "careunit", "intime")


@register("subject_list", with_ctes("""
SELECT * FROM patients WHERE subject_id IN (SELECT user_id FROM events)""", "patients"))
def q_subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    path = scratch_path(spark, "subjects") + "/demo_subject_id.csv"
    (t.raw("events").select(F.col("user_id").alias("subject_id")).distinct()
     .write.mode("overwrite").option("header", "true").csv(path))
    subjects = I.read_subject_list(spark, path)
    return I.restrict_to_subjects(t.patients, subjects)


def _exported(name: str, df: DataFrame) -> DataFrame:
    """A bound table as the hospital would export it, with some faults by rule: unknown
    genders, patients that are there twice, an impossible ICD version."""
    if name == "patients":
        df = df.withColumn("gender", F.when(F.col("subject_id") % 50 == 0, "X").otherwise(F.col("gender")))
        df = df.unionByName(df.where("subject_id % 40 = 1"))
    if name == "diagnoses_icd":
        df = df.withColumn("icd_version", F.when(F.col("hadm_id") % 30 == 0, 11).otherwise(F.col("icd_version")))
    known = [c for c in df.columns if c in SPECS[name].column_names]
    times = {f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp_ntz", "timestamp")}
    return df.select(*[F.date_format(c, _TS_FMT).alias(c) if c in times else F.col(c).cast("string").alias(c) for c in known])


def _load_sql() -> str:
    """The load in SQL: checks, repeated keys, then orphans against the good parents, in
    load order, so that a refused patient takes the admissions along."""
    exported = {"patients": """SELECT * REPLACE (CASE WHEN subject_id % 50 = 0 THEN 'X' ELSE gender END AS gender) FROM patients
                  UNION ALL SELECT * REPLACE (CASE WHEN subject_id % 50 = 0 THEN 'X' ELSE gender END AS gender) FROM patients WHERE subject_id % 40 = 1""",
                "diagnoses_icd": "SELECT * REPLACE (CASE WHEN hadm_id % 30 = 0 THEN 11 ELSE icd_version END AS icd_version) FROM diagnoses_icd"}
    absent = {"drgcodes": ["subject_id"], "patients": ["anchor_year"], "admissions": ["hospital_expire_flag"]}
    ctes, report = [], []
    for name in [n for n in LOAD_ORDER if n in _BOUND_TABLES]:
        spec = SPECS[name]
        missing = absent.get(name, [])
        ctes.append((f"x_{name}", "SELECT *" + "".join(f", NULL AS {c}" for c in missing) + f" FROM ({exported.get(name, f'SELECT * FROM {name}')}) e"))
        held = _COLUMNS[name] + missing
        faults = []
        for c in spec.columns:
            if not c.nullable:
                faults.append(f"CASE WHEN {c.name} IS NULL THEN '{c.name}_not_null' END")
            if c.max_len is not None and c.name in held:
                faults.append(f"CASE WHEN length(CAST({c.name} AS VARCHAR)) > {c.max_len} THEN '{c.name}_max_len_{c.max_len}' END")
        faults += [f"CASE WHEN NOT coalesce({p}, true) THEN '{n}' END" for n, p in spec.checks]
        ctes.append((f"f_{name}", f"SELECT *, concat_ws(',', '', {', '.join(faults) or 'NULL'}) AS faults FROM x_{name}"))
        number = f"row_number() OVER (PARTITION BY {', '.join(spec.key)})" if spec.policy == I.FIRST_WINS and spec.key else "1"
        whole = " OR ".join(f"{k} IS NULL" for k in spec.key) or "false"
        ctes.append((f"u_{name}", f"SELECT *, CASE WHEN {whole} THEN 1 ELSE {number} END AS copy FROM f_{name} WHERE faults = ''"))
        lost = [f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM g_{p} WHERE {pc} IS NOT NULL) THEN '{c}_not_in_{p}' END"
                for c, p, pc in spec.fks if c in held]
        ctes.append((f"o_{name}", f"SELECT *, concat_ws(',', {', '.join(lost) or 'NULL'}) AS lost FROM u_{name} WHERE copy = 1"))
        ctes.append((f"g_{name}", f"SELECT * FROM o_{name} WHERE lost = ''"))
        report += [f"SELECT '{name}' AS table_name, substr(faults, 2) AS reasons FROM f_{name} WHERE faults <> ''",
                   f"SELECT '{name}', 'duplicate_key' FROM u_{name} WHERE copy > 1", f"SELECT '{name}', lost FROM o_{name}"]
    return with_ctes(f"SELECT table_name, reasons, count(*) AS row_count FROM ({' UNION ALL '.join(report)}) r GROUP BY 1, 2",
                     *_BOUND_TABLES, extra=tuple(ctes))


#: bound columns with a length limit or a key, by table
_COLUMNS = {
    "patients": ["subject_id", "gender", "anchor_age", "anchor_year_group"],
    "admissions": ["hadm_id", "subject_id", "admittime", "dischtime", "admission_type", "admission_location", "discharge_location", "insurance", "race"],
    "d_labitems": ["itemid", "label", "fluid", "category"], "d_items": ["itemid", "label", "category"],
    "labevents": ["subject_id", "hadm_id", "itemid", "valueuom", "flag"],
    "d_icd_diagnoses": ["icd_code"], "d_icd_procedures": ["icd_code"], "diagnoses_icd": ["subject_id", "hadm_id", "icd_code"],
    "procedures_icd": ["subject_id", "hadm_id", "icd_code"], "prescriptions": ["subject_id", "hadm_id", "route"],
    "emar": ["subject_id", "emar_id", "event_txt"],
    "poe": ["poe_id", "subject_id", "hadm_id", "order_type", "order_subtype", "transaction_type", "order_provider_id", "order_status"],
    "drgcodes": ["hadm_id", "drg_type", "drg_code"], "icustays": ["stay_id", "subject_id", "hadm_id", "first_careunit", "last_careunit"],
    "chartevents": ["subject_id", "hadm_id", "stay_id", "itemid", "valueuom"],
    "inputevents": ["subject_id", "hadm_id", "stay_id", "itemid", "amountuom", "rateuom", "ordercategoryname", "statusdescription"],
}


@register("load_all", _load_sql())
def q_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bound table written as CSV, loaded through the whole path, reported by table and
    reason."""
    t, root = ClinicalTables(spark, sf_dir), scratch_path(spark, "load")
    t.bind_events_once()
    for name in _BOUND_TABLES:
        _write_csv(_exported(name, getattr(t, name)), f"{root}/export/{SPECS[name].module}/{name}.csv")
    I.load_all(spark, f"{root}/export", f"{root}/tables")
    return I.load_report(spark, f"{root}/tables")


# ---------------------------------------------------------------------------
# Query log sinks and citations
# ---------------------------------------------------------------------------

def kb_responses(t: ClinicalTables) -> DataFrame:
    """A retrieve-and-generate response for every successful question, in the service's
    nested shape, over the whole text of a document (the documents take turns by the
    question's id): up to two citation groups with one or two references (whole text,
    second half, first half without a location). Documents of every fifth id give no
    second group, of every third one reference in it."""
    e = t.raw("events").filter(F.col("event_type") != "error").select("event_id", "ts")
    d = t.raw("documents").select("doc_id", "text", "lang", "source")
    turn = F.pmod("event_id", F.lit(max(1, d.count())))
    j = e.join(dense_rank_all(d, "doc_id", "_turn"), turn == F.col("_turn"), "inner")
    uri = F.when(F.col("source") == "src0", F.lit("")).otherwise(
        F.concat(F.lit("s3://kb-docs/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"),
                 F.lit(".md")))
    ltype = F.when(F.col("lang") != "de", F.lit("S3"))

    def ref(text, with_location=True):
        loc = (F.struct(ltype.alias("type"), F.struct(uri.alias("uri")).alias("s3Location"))
               if with_location else F.lit(None).cast("struct<type:string,s3Location:struct<uri:string>>"))
        return F.struct(F.struct(text.alias("text")).alias("content"), loc.alias("location"))

    half = F.floor(F.char_length("text") / 2).cast("int")
    second, first = ref(F.expr("substring(text, cast(char_length(text) div 2 as int) + 1)")), ref(F.left("text", half), with_location=False)
    refs1 = F.when(F.col("doc_id") % 3 == 0, F.array(second)).otherwise(F.array(second, first))
    groups = F.array(F.struct(F.array(ref(F.col("text"))).alias("retrievedReferences")), F.struct(refs1.alias("retrievedReferences")))
    return j.select(F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"),
                    F.when(F.col("doc_id") % 5 == 0, F.slice(groups, 1, 1)).otherwise(groups).alias("citations"))


_REFS_SQL = """SELECT event_id AS query_id, ts AS created_at, 0 AS citation_pos, 0 AS reference_pos,
    uri, text AS excerpt, coalesce(ltype, 'S3') AS rtype FROM rj
  UNION ALL SELECT event_id, ts, 1, 0, uri, substring(text, CAST(length(text) // 2 AS BIGINT) + 1), coalesce(ltype, 'S3') FROM rj
    WHERE doc_id % 5 <> 0
  UNION ALL SELECT event_id, ts, 1, 1, '', left(text, CAST(length(text) // 2 AS BIGINT)), 'S3' FROM rj
    WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0"""
_RJ_SQL = """SELECT e.event_id, e.ts, d.doc_id, d.text,
    CASE WHEN d.source = 'src0' THEN '' ELSE 's3://kb-docs/' || d.source || '/doc-' || CAST(d.doc_id AS VARCHAR) || '.md' END AS uri,
    CASE WHEN d.lang <> 'de' THEN 'S3' END AS ltype
  FROM events e JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS turn FROM documents) d
    ON e.event_id % (SELECT count(*) FROM documents) = d.turn WHERE e.event_type <> 'error'"""
_FLAT_SQL = """SELECT query_id, citation_pos, reference_pos,
    CASE WHEN uri = '' THEN 'Unknown' ELSE regexp_extract(uri, '[^/]*$') END AS source_document,
    CASE WHEN coalesce(excerpt, '') = '' THEN NULL ELSE substring(excerpt, 1, 1000) END AS excerpt_text,
    CAST(json_object('s3_uri', uri, 'reference_type', rtype) AS VARCHAR) AS metadata, created_at, uri
  FROM refs"""
_CITE_CTES = (("rj", _RJ_SQL), ("refs", _REFS_SQL), ("flat", _FLAT_SQL))


@register("flatten_citations", with_ctes("""
SELECT query_id, citation_pos, reference_pos, source_document, excerpt_text, metadata FROM flat""",
    extra=_CITE_CTES))
def q_flatten_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.flatten_citations(kb_responses(ClinicalTables(spark, sf_dir)))


@register("citation_previews", with_ctes("""
SELECT query_id, citation_pos, reference_pos,
  CASE WHEN citation_pos = 1 AND reference_pos = 1 THEN 'Unknown source' ELSE regexp_extract(uri, '[^/]*$') END AS source,
  CASE WHEN length(excerpt) > 200 THEN left(excerpt, 200) || '...' ELSE excerpt END AS excerpt,
  left(excerpt, 200) || '...' AS short_excerpt
FROM refs""", extra=_CITE_CTES[:2]))
def q_citation_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.citation_previews(kb_responses(ClinicalTables(spark, sf_dir)))


@register("citation_count", with_ctes("""
SELECT query_id, CAST(count(DISTINCT citation_pos) AS INTEGER) AS citation_groups, CAST(count(*) AS INTEGER) AS reference_count
FROM refs GROUP BY query_id""",
    extra=_CITE_CTES[:2]))
def q_citation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = querylog.citation_counts(kb_responses(ClinicalTables(spark, sf_dir)))
    return r.select("query_id", "citation_groups", "reference_count")


@register("distinct_sources", with_ctes("""
SELECT query_id, source_document AS source_name, min(citation_pos) + 1 AS first_group
FROM flat WHERE uri <> '' GROUP BY query_id, source_document""", extra=_CITE_CTES))
def q_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.questions import distinct_sources
    return distinct_sources(kb_responses(ClinicalTables(spark, sf_dir)))


@register("citation_sink", with_ctes("""
SELECT query_id, citation_pos, reference_pos, source_document, excerpt_text, metadata, created_at,
  sha256(concat_ws(chr(1), CAST(query_id AS VARCHAR), CAST(citation_pos AS VARCHAR),
                   CAST(reference_pos AS VARCHAR))) AS citation_key
FROM flat""", extra=_CITE_CTES))
def q_citation_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = kb_responses(ClinicalTables(spark, sf_dir))
    flat = querylog.flatten_citations(resp, carry=("created_at",))
    path = scratch_path(spark, "kb_citations")
    for _ in range(2):  # a rerun must not duplicate
        out = sinks.citation_sink(spark, flat, path)
    return out


@register("query_log_sink", with_ctes("""
SELECT subject_id, query_text, CASE WHEN success THEN 'answer to ' || query_text END AS response_text,
  CASE WHEN event_type = 'view' THEN 'session-' || CAST(subject_id AS VARCHAR) END AS session_id, response_time_ms, citation_count, success,
  error_message, CASE WHEN event_type = 'click' THEN 'direct-query' ELSE 'knowledge-base' END AS model_arn, created_at,
  sha256(concat_ws(chr(1), CASE WHEN event_type = 'view' THEN 'session-' || CAST(subject_id AS VARCHAR) ELSE '\\N' END, CAST(subject_id AS VARCHAR), strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'),
                   query_text)) AS query_key
FROM kb_queries""", "kb_queries"))
def q_query_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    q = (ClinicalTables(spark, sf_dir).kb_queries
         .withColumn("response_text", F.when(F.col("success"), F.concat(F.lit("answer to "), F.col("query_text"))))
         .withColumn("session_id", F.when(et == "view", F.concat(F.lit("session-"), F.col("subject_id").cast("string"))))
         .withColumn("model_arn", F.when(et == "click", "direct-query").otherwise("knowledge-base"))
         .select(*sinks.QUERY_LOG_COLUMNS))
    q = q.unionByName(q)                                   # a batch that holds every row twice
    path = scratch_path(spark, "kb_queries")
    for _ in range(2):
        out = sinks.query_log_sink(spark, q, path)
    return out


@register("json_sink", with_ctes("""
SELECT query_id, query_text, success, response_time_ms, created_at, strftime(created_at, '%Y%m%d') AS day
FROM kb_queries""", "kb_queries"))
def q_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ClinicalTables(spark, sf_dir).kb_queries.select(
        "query_id", "query_text", "success", "response_time_ms", "created_at")
    path = scratch_path(spark, "results_json")
    sinks.json_sink(q, path)
    schema = "query_id BIGINT, query_text STRING, success BOOLEAN, response_time_ms INT, created_at TIMESTAMP_NTZ"
    back = (spark.read.schema(schema + ", day STRING")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))
    return back.select("query_id", "query_text", "success", "response_time_ms", "created_at", "day")


def source_registry(t: ClinicalTables) -> DataFrame:
    d = t.raw("documents")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("document_name"),
        F.col("lang").alias("document_type"),
        F.concat(F.lit("s3://kb-docs/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"),
                 F.lit(".md")).alias("s3_uri"),
        F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")).alias("word_count"))


_REGISTRY_SQL = """SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS document_name, lang AS document_type,
  's3://kb-docs/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS s3_uri,
  CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS INTEGER) AS word_count
  FROM documents"""


@register("source_registry", with_ctes("SELECT * FROM reg", extra=(("reg", _REGISTRY_SQL),)))
def q_source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_registry(ClinicalTables(spark, sf_dir))


@register("source_citation_counts", with_ctes("""
SELECT reg.*, CAST(coalesce(c.n, 0) AS BIGINT) AS citation_count FROM reg
LEFT JOIN (SELECT source_document, count(*) AS n FROM flat GROUP BY 1) c ON reg.document_name = c.source_document""",
    extra=(("reg", _REGISTRY_SQL),) + _CITE_CTES))
def q_source_citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    cites = querylog.flatten_citations(kb_responses(t))
    return querylog.source_citation_counts(source_registry(t), cites)


@register("cascade_delete", with_ctes("""
SELECT query_id, citation_pos, reference_pos, source_document FROM flat
WHERE query_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')""", extra=_CITE_CTES))
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    resp = kb_responses(t)
    queries = resp.select("query_id", "created_at")
    cites = querylog.flatten_citations(resp)
    deleted = t.raw("events").filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("query_id"))
    _, kept = querylog.cascade_delete(queries, cites, deleted)
    return kept.select("query_id", "citation_pos", "reference_pos", "source_document")
