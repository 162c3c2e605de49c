"""Record retrievals Q1–Q12, re-aimed from one subject per call to all subjects.

Every function takes clinical-schema DataFrames (``subject_id`` keyed) and
returns one DataFrame for every subject at once. Per-subject ``LIMIT k``
becomes ``row_number() <= k`` (see :mod:`topk`). Where the reference joins a
dictionary on its primary key *after* filtering, we rank first and join the
k survivors, so the join touches k rows per subject instead of the whole
event table. Dictionaries are joined without a broadcast hint: Spark's size
estimate (``autoBroadcastJoinThreshold``) and AQE decide, and a dictionary
that outgrows the threshold falls back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .scan import rank_all_by_time
from .topk import asc, desc, top_k_per_key

# Default k per retrieval (the reference's method defaults).
DEFAULT_K = {
    "recent_admissions": 3, "diagnosis_counts": 10, "procedure_history": 10,
    "recent_labs": 15, "recent_prescriptions": 15, "medication_administrations": 10,
    "provider_orders": 10, "recent_vitals": 20, "icu_inputs": 10,
}


def _ranked(df: DataFrame, order, ties: list[str], k: int | None, key: str = "subject_id") -> DataFrame:
    tie_cols = [F.col(c).asc_nulls_last() for c in ties]
    return top_k_per_key(df, [key], list(order) + tie_cols, k, order_names=list(df.columns))


def dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` dealt by subject to ``tasks`` tasks, where what follows by subject stays; as it is without."""
    return df if tasks is None else df.repartition(tasks, "subject_id")


# Q1 ------------------------------------------------------------------------

def subject_exists(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """Add ``subject_exists`` to each request (COUNT(*) > 0 on patients)."""
    known = patients.select("subject_id").distinct().withColumn("_known", F.lit(True))
    return (requests.join(known, "subject_id", "left")
            .withColumn("subject_exists", F.coalesce(F.col("_known"), F.lit(False)))
            .drop("_known"))


# Q2 ------------------------------------------------------------------------

def subject_profile(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame,
                    icustays: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Demographics + distinct counts per subject (fan-out eliminated, §4.2).

    COUNT DISTINCT and MAX ignore the duplicates a 4-way LEFT JOIN creates, so
    aggregating each child per subject first is exactly equal and linear.
    """
    adm = admissions.groupBy("subject_id").agg(
        F.countDistinct("hadm_id").alias("total_admissions"),
        F.max("admittime").alias("most_recent_admission"))
    dx = diagnoses.groupBy("subject_id").agg(F.countDistinct("icd_code").alias("unique_diagnoses"))
    icu = icustays.groupBy("subject_id").agg(F.countDistinct("stay_id").alias("icu_stays"))
    rx = prescriptions.groupBy("subject_id").agg(F.countDistinct("drug").alias("unique_medications"))
    p = patients.select("subject_id", "gender", "anchor_age", "anchor_year_group", "dod")
    out = (p.join(adm, "subject_id", "left").join(dx, "subject_id", "left")
           .join(icu, "subject_id", "left").join(rx, "subject_id", "left"))
    return out.select(
        "subject_id", "gender", "anchor_age", "anchor_year_group",
        F.coalesce("total_admissions", F.lit(0)).alias("total_admissions"),
        F.coalesce("unique_diagnoses", F.lit(0)).alias("unique_diagnoses"),
        F.coalesce("icu_stays", F.lit(0)).alias("icu_stays"),
        F.coalesce("unique_medications", F.lit(0)).alias("unique_medications"),
        "most_recent_admission",
        S.vital_status("dod").alias("status"),
    )


# Q3 ------------------------------------------------------------------------

ADMISSION_COLS = ["hadm_id", "admittime", "dischtime", "admission_type", "admission_location",
                  "discharge_location", "insurance", "race"]
DRG_COLS = ["drg_code", "drg_description", "drg_severity", "drg_mortality"]


def recent_admissions(admissions: DataFrame, drgcodes: DataFrame, k: int = 3) -> DataFrame:
    """Newest admissions with LOS and DRG. The DRG join fans out *before* the
    limit (k counts joined rows), as in the reference.

    Because every admission yields at least one joined row and rows are ordered
    by admission columns first, only the first k admissions per subject can
    reach the result: we limit admissions, join, then limit the joined rows.
    """
    adm = admissions.select("subject_id", *ADMISSION_COLS)
    adm_k = _ranked(adm, [desc("admittime")], ADMISSION_COLS[:1] + ADMISSION_COLS[2:], k).drop("rn")
    drg = drgcodes.select("hadm_id", "drg_code", F.col("description").alias("drg_description"),
                          "drg_severity", "drg_mortality")
    joined = adm_k.join(drg, "hadm_id", "left").withColumn(
        "los_days", S.los_days("admittime", "dischtime"))
    ranked = _ranked(joined, [desc("admittime")],
                     ADMISSION_COLS[:1] + ADMISSION_COLS[2:] + DRG_COLS, k)
    return ranked.select("subject_id", "rn", *ADMISSION_COLS, "los_days", *DRG_COLS)


# Q4 ------------------------------------------------------------------------

def _titles(dictionary: DataFrame) -> DataFrame:
    """Titles of each code, and how often the dictionary holds each: a join before the
    count would have counted an event once for each of them."""
    return dictionary.groupBy("icd_code", "icd_version", "long_title").agg(F.count(F.lit(1)).alias("_repeats"))


def diagnosis_counts(diagnoses: DataFrame, d_icd_diagnoses: DataFrame, admissions: DataFrame,
                     k: int = 10, tasks: int | None = None) -> DataFrame:
    """Diagnoses grouped by (code, version, title, seq) with count and latest admit. The
    events are counted by code; the titles meet the groups only, and where no title is held
    twice under its code, so that none changes a count, only the first k groups per subject.
    With ``tasks``, ``diagnoses`` lie by subject; where no admission is held twice either, only
    the events of those k groups are joined with the admissions."""
    group = ["subject_id", "icd_code", "icd_version", "seq_num"]
    d = diagnoses.select("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version")
    a = admissions.select("hadm_id", "admittime")
    titles = _titles(d_icd_diagnoses)
    single = titles.where("_repeats > 1").isEmpty()
    if single and tasks is not None and a.dropna(subset=["hadm_id"]).groupBy("hadm_id").count().where("count > 1").isEmpty():
        first = Window.partitionBy("subject_id").orderBy(desc("_n"), asc("seq_num"), asc("icd_code"), asc("icd_version"))
        d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        d = d.withColumn("_place", F.dense_rank().over(first)).filter(F.col("_place") <= k).drop("_n", "_place")
    codes = (dealt(d.join(a, "hadm_id", "left"), tasks).groupBy(*group)
             .agg(F.count(F.lit(1)).alias("_n"), F.max("admittime").alias("most_recent")))
    if single:
        codes = _ranked(codes, [desc("_n"), asc("seq_num")], ["icd_code", "icd_version"], k).drop("rn")
    g = codes.join(titles, ["icd_code", "icd_version"], "left").withColumn(
        "occurrence_count", F.col("_n") * F.coalesce("_repeats", F.lit(1))).drop("_n", "_repeats")
    ranked = _ranked(dealt(g, tasks), [desc("occurrence_count"), asc("seq_num")],
                     ["icd_code", "icd_version", "long_title", "most_recent"], k)
    return ranked.select("subject_id", "rn", "icd_code", "icd_version", "long_title", "seq_num",
                         "occurrence_count", "most_recent")


# Q5 ------------------------------------------------------------------------

def procedure_history(procedures: DataFrame, d_icd_procedures: DataFrame, k: int = 10, tasks: int | None = None) -> DataFrame:
    """Procedures grouped by (code, title, date) with their count; titles as in Q4.

    Every (date, code) gives at least one row and rows are ordered by them first, so the
    titles meet the first k of these per subject only."""
    first = Window.partitionBy("subject_id").orderBy(desc("chartdate"), asc("icd_code"))
    p = procedures.select("subject_id", "icd_code", "icd_version", "chartdate").withColumn("_place", F.dense_rank().over(first))
    codes = p.filter(F.col("_place") <= k).groupBy("subject_id", "icd_code", "icd_version", "chartdate").agg(F.count(F.lit(1)).alias("_n"))
    g = (dealt(codes.join(_titles(d_icd_procedures), ["icd_code", "icd_version"], "left"), tasks)
         .groupBy("subject_id", "icd_code", "long_title", "chartdate")
         .agg(F.sum(F.col("_n") * F.coalesce("_repeats", F.lit(1))).alias("occurrence_count")))
    ranked = _ranked(g, [desc("chartdate")], ["icd_code", "long_title", "occurrence_count"], k)
    return ranked.select("subject_id", "rn", "icd_code", "long_title", "chartdate", "occurrence_count")


# Q6 ------------------------------------------------------------------------

LAB_EVENT_COLS = ["itemid", "value", "valuenum", "valueuom", "flag", "ref_range_lower", "ref_range_upper"]


def recent_labs(labevents: DataFrame, d_labitems: DataFrame, k: int = 15) -> DataFrame:
    """Newest charted lab results; the dictionary is joined to the k survivors."""
    le = labevents.filter(F.col("charttime").isNotNull()).select("subject_id", "charttime", *LAB_EVENT_COLS)
    top = _ranked(le, [desc("charttime")], LAB_EVENT_COLS, k)
    li = d_labitems.select("itemid", "label", "fluid", "category")
    return top.join(li, "itemid", "left").select(
        "subject_id", "rn", "charttime", "label", "fluid", "category", "value", "valuenum",
        "valueuom", "flag", "ref_range_lower", "ref_range_upper")


# Q7 ------------------------------------------------------------------------

RX_COLS = ["drug", "drug_type", "route", "starttime", "stoptime", "dose_val_rx", "dose_unit_rx",
           "form_rx", "gsn", "ndc"]


def recent_prescriptions(prescriptions: DataFrame, k: int = 15) -> DataFrame:
    rx = prescriptions.filter(F.col("drug").isNotNull()).select("subject_id", *RX_COLS)
    ranked = _ranked(rx, [desc("starttime")], [c for c in RX_COLS if c != "starttime"], k)
    return ranked.select("subject_id", "rn", *RX_COLS)


# Q8 ------------------------------------------------------------------------

EMAR_COLS = ["charttime", "medication", "event_txt", "scheduletime"]


def medication_administrations(emar: DataFrame, k: int = 10) -> DataFrame:
    e = emar.filter(F.col("medication").isNotNull()).select("subject_id", *EMAR_COLS)
    ranked = _ranked(e, [desc("charttime")], EMAR_COLS[1:], k)
    return ranked.select("subject_id", "rn", *EMAR_COLS)


# Q9 ------------------------------------------------------------------------

POE_COLS = ["poe_id", "ordertime", "order_type", "order_subtype", "transaction_type",
            "order_provider_id", "order_status"]


def provider_orders(poe: DataFrame, k: int = 10) -> DataFrame:
    p = poe.select("subject_id", *POE_COLS)
    ranked = _ranked(p, [desc("ordertime")], [c for c in POE_COLS if c != "ordertime"], k)
    return ranked.select("subject_id", "rn", *POE_COLS)


# Q10 -----------------------------------------------------------------------

ICU_COLS = ["stay_id", "hadm_id", "first_careunit", "last_careunit", "intime", "outtime", "los_days"]


def icu_stays(icustays: DataFrame) -> DataFrame:
    """All ICU stays per subject, newest first (no limit: a full ranking)."""
    cols = icustays.columns
    s = icustays.select(
        "subject_id", "stay_id", "hadm_id", "first_careunit", "last_careunit", "intime",
        (F.col("outtime") if "outtime" in cols else F.lit(None).cast("timestamp_ntz")).alias("outtime"),
        F.col("los").alias("los_days"))
    # a full ranking (no limit): ranked per (subject, time bucket) plus offsets,
    # so a subject with a third of all stays is not sorted in one task
    ties = [F.col(c).asc_nulls_last() for c in ICU_COLS if c != "intime"]
    first = next(c for c in ICU_COLS if c != "intime")
    ranked = rank_all_by_time(s, "subject_id", "intime", ties, "rn", first_tie=first)
    return ranked.select("subject_id", "rn", *ICU_COLS)


# Q11 -----------------------------------------------------------------------

VITAL_CATEGORIES = ("Vital Signs", "Labs", "Respiratory")  # fixed values from the reference query
#: items of a dictionary that is joined as it is, about what Spark sends to every task
ITEMS_AT_HAND = 1 << 16


def recent_vitals(chartevents: DataFrame, d_items: DataFrame, k: int = 20, tasks: int | None = None) -> DataFrame:
    """Charted values in the vital categories. LEFT JOIN + a filter on the right
    side is an inner join; the filtered dictionary is the small side.

    With ``tasks``, ``chartevents`` lie by subject. When the dictionary is too large to be sent
    to them they stay there all the same: each (subject, item) meets it once and comes back to
    that many tasks with what it holds of the item. Of the events of an item the first k are
    enough, as within it they are ranked in one order."""
    di = d_items.filter(F.col("category").isin(*VITAL_CATEGORIES)).select("itemid", "label", "category")
    shown = ["value", "valuenum", "valueuom", "status"]
    ce = chartevents.withColumn("status", S.warning_status("warning")).select("subject_id", "itemid", "charttime", *shown)
    if tasks is None or di.limit(ITEMS_AT_HAND + 1).count() <= ITEMS_AT_HAND:
        j = dealt(ce.join(di, "itemid", "inner"), tasks)
    else:
        # a join on both columns would deal the events anew by both; a window stays by subject,
        # if what was dealt comes first in the union
        pairs = ce.select("subject_id", "itemid").distinct().repartition(tasks, "itemid")
        items = dealt(pairs.join(di, "itemid", "inner"), tasks).select(
            "subject_id", "itemid", F.struct("label", "category").alias("_item"))
        same = Window.partitionBy("subject_id", "itemid")
        ce = ce.withColumn("_first", F.row_number().over(same.orderBy(desc("charttime"), *map(asc, shown)))).filter(F.col("_first") <= k)
        j = items.unionByName(ce, allowMissingColumns=True).withColumn("_items", F.collect_list("_item").over(same))
        j = j.filter("_first IS NOT NULL").withColumn("_item", F.explode("_items")).withColumns(
            {"label": F.col("_item.label"), "category": F.col("_item.category")})
    j = j.select("subject_id", "charttime", "label", "category", *shown, "itemid")
    ranked = _ranked(j, [desc("charttime")], ["itemid", "label", "category", *shown], k)
    return ranked.select("subject_id", "rn", "charttime", "label", "category", "value", "valuenum",
                         "valueuom", "status")


# Q12 -----------------------------------------------------------------------

INPUT_COLS = ["starttime", "endtime", "itemid", "amount", "amountuom", "rate", "rateuom",
              "ordercategoryname", "statusdescription"]


def icu_inputs(inputevents: DataFrame, d_items: DataFrame, k: int = 10) -> DataFrame:
    ie = inputevents.select("subject_id", *INPUT_COLS)
    top = _ranked(ie, [desc("starttime")], [c for c in INPUT_COLS if c != "starttime"], k)
    di = d_items.select("itemid", "label")
    return top.join(di, "itemid", "left").select(
        "subject_id", "rn", "starttime", "endtime", "label", "amount", "amountuom", "rate", "rateuom",
        "ordercategoryname", "statusdescription")
