"""Binding of the driver's tables to the clinical roles.

Each clinical table is a *projection* of a driver table, so every operator
written against the clinical schema also runs here unchanged. The same binding
is spelled twice: as DataFrame code (used by ``queries()``) and as DuckDB CTE
text (used by ``oracle_sql()``). The two are kept side by side on purpose.

Stand-ins: customer = patients, orders = admissions / poe / icustays,
lineitem ⋈ orders = clinical events (labs, diagnoses, procedures,
prescriptions, chart and input events), part = item dictionaries,
supplier = procedure dictionary, events = query log / eMAR.

Derived flags (NULLs, zeros, unmatched dictionary keys) are injected with
deterministic CASE expressions so the N-rules (NULL order, truthiness) are
exercised. Three roles are defined by a filter: DRG codes are the returned
lines, ICU stays the urgent orders, and survey scores the purchase events. No
other row is left out: every successful event has a response, over documents
that take turns (``roundtrip.kb_responses``).
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: what the event roles read of a line
_EVENT_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"]
#: lines that one task joins or ranks, about
LINES_A_TASK = 1 << 18
#: lines of one subject from which on the events are not dealt by subject
HOT_LINES = 1 << 22


class ClinicalTables:
    """Lazily built clinical-role DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- patients ----------------------------------------------------------
    @cached_property
    def patients(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
            (F.col("c_nationkey") * 3 + 18).cast("int").alias("anchor_age"),
            F.col("c_mktsegment").alias("anchor_year_group"),
            F.when(F.col("c_acctbal") < 0, F.to_date(F.lit("2001-12-31"))).alias("dod"),
        )

    # -- admissions: orders; discharge = admit + (floor(price) mod 15) days,
    #    still open (NULL) while the order is open; a projection, no join -------
    @cached_property
    def admissions(self) -> DataFrame:
        o = self.raw("orders")
        stay_days = (F.floor(F.col("o_totalprice")).cast("bigint") % 15).cast("int")
        return o.select(
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderdate").alias("admittime"),
            F.when(F.col("o_orderstatus") != "O", F.timestamp_add("DAY", stay_days, F.col("o_orderdate")))
            .alias("dischtime"),
            F.col("o_orderpriority").alias("admission_type"),
            F.col("o_orderstatus").alias("admission_location"),
            F.when(F.col("o_totalprice") > 250000, "HOME").otherwise("SKILLED NURSING")
            .alias("discharge_location"),
            F.when(F.col("o_totalprice") >= 100000, "Medicare").otherwise("Other").alias("insurance"),
            F.lit("UNKNOWN").alias("race"),
        )

    @cached_property
    def drgcodes(self) -> DataFrame:
        li = self.raw("lineitem").filter(F.col("l_returnflag") == "R")
        return li.select(
            F.col("l_orderkey").alias("hadm_id"),
            F.lit("APR").alias("drg_type"),
            F.col("l_partkey").cast("string").alias("drg_code"),
            F.concat(F.lit("DRG group "), F.col("l_suppkey").cast("string")).alias("description"),
            (F.col("l_linenumber") % 3).cast("int").alias("drg_severity"),
            (F.col("l_linenumber") % 4 + 1).cast("int").alias("drg_mortality"),
        )

    # -- clinical events: lineitem with its subject ------------------------
    @cached_property
    def events_base(self) -> DataFrame:
        li = self.raw("lineitem")
        o = self.raw("orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("subject_id"))
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")

    @cached_property
    def tasks(self) -> int:
        """Tasks for work on all lines: as many as the session asks for, more for a large table."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.raw("lineitem").count() // LINES_A_TASK))

    def events_dealt(self, subjects: DataFrame | None = None) -> DataFrame:
        """The events (of ``subjects``, if given), joined in ``tasks`` tasks by order: what groups
        them by stay or admission (among other columns) goes on in the same tasks, whose memory
        does not grow with the table."""
        li = self.raw("lineitem").select(*_EVENT_COLUMNS).repartition(self.tasks, "l_orderkey")
        o = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
        if subjects is not None:
            o = o.join(subjects, "subject_id", "left_semi")
        return li.join(o.repartition(self.tasks, "l_orderkey"), "l_orderkey").select("subject_id", *_EVENT_COLUMNS)

    def bind_events_once(self, subjects: DataFrame | None = None) -> int | None:
        """Write the bound events (of ``subjects``, if given) to the shared scratch folder
        and let every event role read that: one scan of lineitem and one binding join for
        a query that uses several roles. They are dealt into buckets by subject, so what
        ranks or counts them by subject does not shuffle them again, in a number of tasks
        that grows with them. Returns that number. When one subject has over HOT_LINES the
        buckets are not used, as the rankings cut its rows before they shuffle them: None."""
        path = scratch_path(self.spark, "events")
        e = self.events_dealt(subjects)
        name = f"medlattice_events_{uuid.uuid4().hex[:12]}"
        e.repartition(self.tasks, "subject_id").write.format("parquet").option("path", path).bucketBy(self.tasks, "subject_id").saveAsTable(name)
        dealt = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")            # the name only: the files are outside the warehouse
        hot = not dealt.groupBy("subject_id").count().where(F.col("count") > HOT_LINES).isEmpty()
        self.__dict__["events_base"] = self.spark.read.schema(e.schema).parquet(path) if hot else dealt
        return None if hot else self.tasks

    @cached_property
    def diagnoses_icd(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("seq_num"),
            F.col("l_partkey").cast("string").alias("icd_code"),
            F.when(F.col("l_linestatus") == "O", 10).otherwise(9).cast("int").alias("icd_version"),
        )

    @cached_property
    def d_icd_diagnoses(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").cast("string").alias("icd_code"),
            F.when(F.col("p_size") % 2 == 0, 10).otherwise(9).cast("int").alias("icd_version"),
            F.concat_ws(" ", "p_name", "p_type", "p_brand", F.repeat(F.lit("x"), F.col("p_size")))
            .alias("long_title"),
        )

    @cached_property
    def procedures_icd(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("seq_num"),
            F.col("l_shipdate").alias("chartdate"),
            F.col("l_suppkey").cast("string").alias("icd_code"),
            F.lit(10).cast("int").alias("icd_version"),
        )

    @cached_property
    def d_icd_procedures(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").cast("string").alias("icd_code"),
            F.when(F.col("s_nationkey") % 5 == 0, 9).otherwise(10).cast("int").alias("icd_version"),
            F.concat(F.col("s_name"), F.lit(" procedure")).alias("long_title"),
        )

    @cached_property
    def labevents(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_partkey").alias("itemid"),
            F.col("l_shipdate").alias("charttime"),
            F.when(F.col("l_returnflag") == "A", "pos").when(F.col("l_returnflag") == "N", "")
            .alias("value"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit(0.0))
            .otherwise(F.col("l_quantity")).alias("valuenum"),
            F.lit("mg/dL").alias("valueuom"),
            F.when(F.col("l_discount") >= 0.08, "abnormal").alias("flag"),
            F.when((F.col("l_linenumber") > 1) & (F.col("l_linenumber") != 2), F.col("l_linenumber").cast("double"))
            .alias("ref_range_lower"),
            F.when(F.col("l_linenumber") != 2, F.lit(50.0)).alias("ref_range_upper"),
        )

    @cached_property
    def d_labitems(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("itemid"),
            F.col("p_name").alias("label"),
            F.col("p_brand").alias("fluid"),
            F.col("p_type").alias("category"),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("drug-"), F.col("l_partkey").cast("string")))
            .alias("drug"),
            F.when(F.col("l_tax") != 0, "MAIN").alias("drug_type"),
            F.when(F.col("l_discount") < 0.05, "PO").when(F.col("l_discount") < 0.08, "IV").alias("route"),
            F.when((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F"), F.lit(None))
            .otherwise(F.col("l_shipdate")).alias("starttime"),
            F.col("l_shipdate").alias("stoptime"),
            F.col("l_quantity").cast("bigint").cast("string").alias("dose_val_rx"),
            F.lit("mg").alias("dose_unit_rx"),
            F.lit("TAB").alias("form_rx"),
            F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("gsn"),
            F.lpad(F.col("l_partkey").cast("string"), 11, "0").alias("ndc"),
        )

    @cached_property
    def emar(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("user_id").alias("subject_id"),
            F.col("event_id").cast("string").alias("emar_id"),
            F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(F.col("ts")).alias("charttime"),
            F.when(F.col("event_type") != "error", F.concat(F.lit("med-"), F.col("event_type")))
            .alias("medication"),
            F.when(F.col("event_type") == "click", "Administered")
            .when(F.col("event_type") == "purchase", "Not Given")
            .when(F.col("event_type") == "signup", "Held").alias("event_txt"),
            F.col("ts").alias("scheduletime"),
        )

    @cached_property
    def poe(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
            .alias("poe_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_orderdate").alias("ordertime"),
            F.when(F.col("o_orderstatus") != "P", "Medications").alias("order_type"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("order_subtype"),
            F.lit("New").alias("transaction_type"),
            F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("P"), F.col("o_custkey").cast("string")))
            .alias("order_provider_id"),
            F.when(F.col("o_orderstatus") == "F", "Inactive").when(F.col("o_orderstatus") == "O", "Active")
            .alias("order_status"),
        )

    @cached_property
    def icustays(self) -> DataFrame:
        o = self.raw("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        return o.select(
            F.col("o_orderkey").alias("stay_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            F.lit("MICU").alias("first_careunit"),
            F.when(F.col("o_orderstatus") == "F", "SICU").otherwise("MICU").alias("last_careunit"),
            F.col("o_orderdate").alias("intime"),
            F.when(F.col("o_orderstatus") == "P", F.lit(0.0))
            .otherwise(F.floor(F.col("o_totalprice") / 1000) / 100).alias("los"),
        )

    @cached_property
    def chartevents(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_orderkey").alias("stay_id"),
            F.col("l_shipdate").alias("charttime"),
            F.col("l_partkey").alias("itemid"),
            F.when(F.col("l_returnflag") == "A", "high").alias("value"),
            F.col("l_quantity").alias("valuenum"),
            F.lit("bpm").alias("valueuom"),
            F.when(F.col("l_discount") >= 0.09, 1).otherwise(0).cast("int").alias("warning"),
        )

    @cached_property
    def d_items(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("itemid"),
            F.col("p_name").alias("label"),
            F.when(F.col("p_type") == "SMALL", "Vital Signs").when(F.col("p_type") == "MEDIUM", "Labs")
            .when(F.col("p_type") == "LARGE", "Respiratory").otherwise("Routine").alias("category"),
        )

    @cached_property
    def inputevents(self) -> DataFrame:
        return self.events_base.select(
            "subject_id",
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_orderkey").alias("stay_id"),
            F.col("l_shipdate").alias("starttime"),
            F.col("l_shipdate").alias("endtime"),
            F.col("l_partkey").alias("itemid"),
            F.col("l_quantity").alias("amount"),
            F.lit("mL").alias("amountuom"),
            F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("double")).alias("rate"),
            F.lit("mL/hour").alias("rateuom"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("0"), F.col("l_returnflag"), F.lit("-Fluids")))
            .alias("ordercategoryname"),
            F.when(F.col("l_linestatus") == "F", "FinishedRunning").otherwise("Paused")
            .alias("statusdescription"),
        )

    # -- query log ----------------------------------------------------------
    @cached_property
    def kb_queries(self) -> DataFrame:
        """events as the query log: one row per question."""
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("query_id"),
            F.col("user_id").alias("subject_id"),
            F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("query_text"),
            F.col("event_type").alias("event_type"),
            F.floor(F.col("value") * 1000).cast("int").alias("response_time_ms"),
            F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
            (F.col("event_type") != "error").alias("success"),
            F.when(F.col("event_type") == "error", F.lit("ThrottlingException: rate exceeded"))
            .alias("error_message"),
            F.col("ts").alias("created_at"),
        )


# ---------------------------------------------------------------------------
# The same binding as DuckDB SQL, for the oracle.
# ---------------------------------------------------------------------------

ORACLE_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "patients": ("""SELECT c_custkey AS subject_id,
        CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CAST(c_nationkey * 3 + 18 AS INTEGER) AS anchor_age,
        c_mktsegment AS anchor_year_group,
        CASE WHEN c_acctbal < 0 THEN DATE '2001-12-31' END AS dod
        FROM customer""", ()),
    "admissions": ("""SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
        o_orderpriority AS admission_type, o_orderstatus AS admission_location,
        CASE WHEN o_totalprice > 250000 THEN 'HOME' ELSE 'SKILLED NURSING' END AS discharge_location,
        CASE WHEN o_totalprice >= 100000 THEN 'Medicare' ELSE 'Other' END AS insurance,
        'UNKNOWN' AS race,
        CASE WHEN o_orderstatus <> 'O'
             THEN o_orderdate + to_days(CAST(CAST(floor(o_totalprice) AS BIGINT) % 15 AS INTEGER)) END AS dischtime
        FROM orders""", ()),
    "drgcodes": ("""SELECT l_orderkey AS hadm_id, 'APR' AS drg_type, CAST(l_partkey AS VARCHAR) AS drg_code,
        'DRG group ' || CAST(l_suppkey AS VARCHAR) AS description,
        CAST(l_linenumber % 3 AS INTEGER) AS drg_severity,
        CAST(l_linenumber % 4 + 1 AS INTEGER) AS drg_mortality
        FROM lineitem WHERE l_returnflag = 'R'""", ()),
    "events_base": ("""SELECT lineitem.*, o_custkey AS subject_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", ()),
    "diagnoses_icd": ("""SELECT subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
        CAST(l_partkey AS VARCHAR) AS icd_code,
        CAST(CASE WHEN l_linestatus = 'O' THEN 10 ELSE 9 END AS INTEGER) AS icd_version
        FROM events_base""", ("events_base",)),
    "d_icd_diagnoses": ("""SELECT CAST(p_partkey AS VARCHAR) AS icd_code,
        CAST(CASE WHEN p_size % 2 = 0 THEN 10 ELSE 9 END AS INTEGER) AS icd_version,
        concat_ws(' ', p_name, p_type, p_brand, repeat('x', p_size)) AS long_title
        FROM part""", ()),
    "procedures_icd": ("""SELECT subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
        l_shipdate AS chartdate, CAST(l_suppkey AS VARCHAR) AS icd_code, CAST(10 AS INTEGER) AS icd_version
        FROM events_base""", ("events_base",)),
    "d_icd_procedures": ("""SELECT CAST(s_suppkey AS VARCHAR) AS icd_code,
        CAST(CASE WHEN s_nationkey % 5 = 0 THEN 9 ELSE 10 END AS INTEGER) AS icd_version,
        s_name || ' procedure' AS long_title
        FROM supplier""", ()),
    "labevents": ("""SELECT subject_id, l_orderkey AS hadm_id, l_partkey AS itemid, l_shipdate AS charttime,
        CASE WHEN l_returnflag = 'A' THEN 'pos' WHEN l_returnflag = 'N' THEN '' END AS value,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS valuenum,
        'mg/dL' AS valueuom,
        CASE WHEN l_discount >= 0.08 THEN 'abnormal' END AS flag,
        CASE WHEN l_linenumber > 1 AND l_linenumber <> 2 THEN CAST(l_linenumber AS DOUBLE) END AS ref_range_lower,
        CASE WHEN l_linenumber <> 2 THEN 50.0::DOUBLE END AS ref_range_upper
        FROM events_base""", ("events_base",)),
    "d_labitems": ("""SELECT p_partkey AS itemid, p_name AS label, p_brand AS fluid, p_type AS category
        FROM part""", ()),
    "prescriptions": ("""SELECT subject_id, l_orderkey AS hadm_id,
        CASE WHEN l_returnflag <> 'N' THEN 'drug-' || CAST(l_partkey AS VARCHAR) END AS drug,
        CASE WHEN l_tax <> 0 THEN 'MAIN' END AS drug_type,
        CASE WHEN l_discount < 0.05 THEN 'PO' WHEN l_discount < 0.08 THEN 'IV' END AS route,
        CASE WHEN l_linenumber = 1 AND l_linestatus = 'F' THEN NULL ELSE l_shipdate END AS starttime,
        l_shipdate AS stoptime,
        CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS dose_val_rx,
        'mg' AS dose_unit_rx, 'TAB' AS form_rx,
        lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS gsn,
        lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS ndc
        FROM events_base""", ("events_base",)),
    "emar": ("""SELECT user_id AS subject_id, CAST(event_id AS VARCHAR) AS emar_id,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS charttime,
        CASE WHEN event_type <> 'error' THEN 'med-' || event_type END AS medication,
        CASE WHEN event_type = 'click' THEN 'Administered' WHEN event_type = 'purchase' THEN 'Not Given'
             WHEN event_type = 'signup' THEN 'Held' END AS event_txt,
        ts AS scheduletime
        FROM events""", ()),
    "poe": ("""SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS poe_id,
        o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS ordertime,
        CASE WHEN o_orderstatus <> 'P' THEN 'Medications' END AS order_type,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS order_subtype,
        'New' AS transaction_type,
        CASE WHEN o_totalprice > 300000 THEN 'P' || CAST(o_custkey AS VARCHAR) END AS order_provider_id,
        CASE WHEN o_orderstatus = 'F' THEN 'Inactive' WHEN o_orderstatus = 'O' THEN 'Active' END AS order_status
        FROM orders""", ()),
    "icustays": ("""SELECT o_orderkey AS stay_id, o_custkey AS subject_id, o_orderkey AS hadm_id,
        'MICU' AS first_careunit,
        CASE WHEN o_orderstatus = 'F' THEN 'SICU' ELSE 'MICU' END AS last_careunit,
        o_orderdate AS intime,
        CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE floor(o_totalprice / 1000) / 100 END AS los
        FROM orders WHERE o_orderpriority = '1-URGENT'""", ()),
    "chartevents": ("""SELECT subject_id, l_orderkey AS hadm_id, l_orderkey AS stay_id, l_shipdate AS charttime,
        l_partkey AS itemid, CASE WHEN l_returnflag = 'A' THEN 'high' END AS value,
        l_quantity AS valuenum, 'bpm' AS valueuom,
        CAST(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS INTEGER) AS warning
        FROM events_base""", ("events_base",)),
    "d_items": ("""SELECT p_partkey AS itemid, p_name AS label,
        CASE WHEN p_type = 'SMALL' THEN 'Vital Signs' WHEN p_type = 'MEDIUM' THEN 'Labs'
             WHEN p_type = 'LARGE' THEN 'Respiratory' ELSE 'Routine' END AS category
        FROM part""", ()),
    "inputevents": ("""SELECT subject_id, l_orderkey AS hadm_id, l_orderkey AS stay_id,
        l_shipdate AS starttime, l_shipdate AS endtime, l_partkey AS itemid,
        l_quantity AS amount, 'mL' AS amountuom,
        CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS DOUBLE) END AS rate,
        'mL/hour' AS rateuom,
        CASE WHEN l_returnflag <> 'N' THEN '0' || l_returnflag || '-Fluids' END AS ordercategoryname,
        CASE WHEN l_linestatus = 'F' THEN 'FinishedRunning' ELSE 'Paused' END AS statusdescription
        FROM events_base""", ("events_base",)),
    "kb_queries": ("""SELECT event_id AS query_id, user_id AS subject_id,
        'question ' || CAST(event_id AS VARCHAR) AS query_text, event_type,
        CAST(floor(value * 1000) AS INTEGER) AS response_time_ms,
        CAST(json_extract(props, '$.k') AS INTEGER) AS citation_count,
        event_type <> 'error' AS success,
        CASE WHEN event_type = 'error' THEN 'ThrottlingException: rate exceeded' END AS error_message,
        ts AS created_at
        FROM events""", ()),
}


def with_ctes(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and their dependencies),
    followed by query-specific ``extra`` (name, sql) CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in ORACLE_CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [(n, ORACLE_CTES[n][0]) for n in order] + list(extra)
    if not ctes:
        return body
    parts = ",\n".join(f"{n} AS ({sql})" for n, sql in ctes)
    return f"WITH {parts}\n{body}"
