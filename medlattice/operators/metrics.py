"""Quality metrics the knowledge corpus defines in prose:
30-day readmission, in-hospital mortality, mean and median length of stay,
percentile rank against peers, event rates per 1,000 patient days and
sex-specific lab-range flags. No reference code computes them; each is a
plain aggregate or key-ordered scan over the clinical tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .scan import exact_quantiles, next_in_key, percent_rank_all


def readmission_30d(admissions: DataFrame, days: int = 30) -> DataFrame:
    """Per admission: the subject's next admission (by admit time, then id) and
    whether it starts within ``days`` days after this discharge. Overlapping
    admissions (next admit before discharge) and open admissions do not count."""
    a = admissions.select("subject_id", "hadm_id", "admission_type", "admittime", "dischtime")
    n = next_in_key(a, "subject_id", "admittime", "hadm_id", ["hadm_id", "admittime"])
    gap = (S.epoch_us("next_admittime") - S.epoch_us("dischtime")) / F.lit(86400e6)
    return n.select(
        "subject_id", "hadm_id", "admission_type", "admittime", "dischtime", "next_hadm_id", "next_admittime",
        F.round(gap, 6).alias("days_to_next"),
        F.coalesce((gap >= 0) & (gap <= days), F.lit(False)).alias(f"readmitted_{days}d"))


def readmission_rate(readmissions: DataFrame, days: int = 30) -> DataFrame:
    """Per admission type: discharged index admissions, readmissions, rate."""
    flag = f"readmitted_{days}d"
    idx = readmissions.filter(F.col("dischtime").isNotNull())
    g = idx.groupBy("admission_type").agg(
        F.count(F.lit(1)).alias("index_admissions"), F.count_if(F.col(flag)).alias("readmissions"))
    return g.withColumn("readmission_rate", F.round(F.col("readmissions") / F.col("index_admissions"), 6))


def inhospital_mortality(admissions: DataFrame) -> DataFrame:
    """Per admission type: admissions, deaths in hospital, mortality rate."""
    g = admissions.groupBy("admission_type").agg(
        F.count(F.lit(1)).alias("admissions"),
        F.sum(F.coalesce(F.col("hospital_expire_flag"), F.lit(0))).cast("long").alias("deaths"))
    return g.withColumn("mortality_rate", F.round(F.col("deaths") / F.col("admissions"), 6))


def los_statistics(admissions: DataFrame) -> DataFrame:
    """Per admission type: discharged admissions, mean and exact median LOS in days
    (ranked in buckets of a quarter day, so no group is held in one buffer)."""
    a = (admissions.filter(F.col("dischtime").isNotNull())
         .select("admission_type", S.los_days("admittime", "dischtime").alias("los")))
    means = a.groupBy("admission_type").agg(F.count(F.lit(1)).alias("discharged"), F.round(F.avg("los"), 6).alias("mean_los_days"))
    middle = exact_quantiles(a, ["admission_type"], "los", {"median_los_days": 0.5}, 0.25).withColumnRenamed("admission_type", "_type")
    return means.join(middle, means["admission_type"].eqNullSafe(middle["_type"]), "left").select(
        "admission_type", "discharged", "mean_los_days", F.round("median_los_days", 6).alias("median_los_days"))


def los_percentile_rank(admissions: DataFrame) -> DataFrame:
    """Per subject: mean LOS over discharged admissions and its percentile rank
    among all such subjects (0 = shortest, 1 = longest)."""
    per = (admissions.filter(F.col("dischtime").isNotNull())
           .groupBy("subject_id").agg(F.round(F.avg(S.los_days("admittime", "dischtime")), 6).alias("mean_los_days")))
    ranked = percent_rank_all(per, "mean_los_days", "_pr")
    return ranked.select("subject_id", "mean_los_days", F.round("_pr", 6).alias("percentile_rank"))


def event_rate_per_1000_days(admissions: DataFrame, events: DataFrame, flag: str = "flag",
                             value: str = "abnormal") -> DataFrame:
    """Per admission type: flagged events during discharged admissions per
    1,000 patient days. Events are counted per admission first, so a hot
    admission contributes one row to the join."""
    ev = (events.filter(F.lower(F.col(flag)) == value).groupBy("hadm_id")
          .agg(F.count(F.lit(1)).alias("_n")))
    a = (admissions.filter(F.col("dischtime").isNotNull())
         .select("hadm_id", "admission_type", S.los_days("admittime", "dischtime").alias("los")))
    g = a.join(ev, "hadm_id", "left").groupBy("admission_type").agg(
        F.sum("los").alias("_days"), F.sum(F.coalesce(F.col("_n"), F.lit(0))).cast("long").alias("events"))
    return g.select(
        "admission_type", F.round("_days", 6).alias("patient_days"), "events",
        F.when(F.col("_days") > 0, F.round(F.col("events") * 1000 / F.col("_days"), 6)).alias("rate_per_1000_days"))


# --- ICD-10 chapter by code range -------------------------------------------------

# The high-level ICD-10-CM chapter groupings the corpus lists
# (first code, last code, chapter), in its order. Codes outside them are 'Unlisted'.
ICD10_CHAPTERS = (
    ("A00", "B99", "Certain infectious and parasitic diseases"),
    ("C00", "D49", "Neoplasms"),
    ("E00", "E89", "Endocrine, nutritional and metabolic diseases"),
    ("I00", "I99", "Diseases of the circulatory system"),
    ("J00", "J99", "Diseases of the respiratory system"),
    ("M00", "M99", "Diseases of the musculoskeletal system and connective tissue"),
    ("N00", "N99", "Diseases of the genitourinary system"),
    ("O00", "O9A", "Pregnancy, childbirth and the puerperium"),
    ("P00", "P96", "Conditions originating in the perinatal period"),
    ("Q00", "Q99", "Congenital malformations, deformations and chromosomal abnormalities"),
    ("R00", "R99", "Symptoms, signs and abnormal clinical and laboratory findings"),
    ("V00", "Y99", "External causes of morbidity"),
    ("Z00", "Z99", "Factors influencing health status and contact with health services"),
)


def icd10_chapter(code: str | Column) -> Column:
    """Chapter of an ICD-10 code by its first three characters (a CASE chain,
    no join): ranges compare as strings, so 'O9A' closes the pregnancy block."""
    c = F.upper(F.substring(F.col(code) if isinstance(code, str) else code, 1, 3))
    out = None
    for lo, hi, name in ICD10_CHAPTERS:
        cond = (c >= F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(c.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit("Unlisted")))


def icd_chapter_counts(diagnoses: DataFrame) -> DataFrame:
    """Per chapter: ICD-10 diagnosis rows, distinct patients and admissions."""
    d = diagnoses.filter(F.col("icd_version") == 10).select(
        "subject_id", "hadm_id", icd10_chapter("icd_code").alias("chapter"))
    return d.groupBy("chapter").agg(
        F.count(F.lit(1)).alias("diagnoses"),
        F.countDistinct("subject_id").alias("patients"),
        F.countDistinct("hadm_id").alias("admissions"))


# --- lab reference ranges ----------------------------------------------------------

# Generic adult reference ranges from the corpus, in its order:
# (analyte, low for males, high for males, low for females, high for females).
GENERIC_LAB_RANGES = (
    ("WBC", 4.5, 11.0, 4.5, 11.0),
    ("RBC", 4.5, 5.9, 4.1, 5.1),
    ("Hemoglobin", 13.5, 17.5, 12.0, 15.5),
    ("Hematocrit", 38.8, 50.0, 34.9, 44.5),
    ("MCV", 80.0, 100.0, 80.0, 100.0),
    ("Platelets", 150.0, 400.0, 150.0, 400.0),
    ("Glucose", 70.0, 100.0, 70.0, 100.0),
    ("BUN", 7.0, 20.0, 7.0, 20.0),
    ("Creatinine", 0.7, 1.3, 0.6, 1.1),
    ("Sodium", 135.0, 145.0, 135.0, 145.0),
    ("Potassium", 3.5, 5.0, 3.5, 5.0),
    ("Chloride", 98.0, 107.0, 98.0, 107.0),
    ("Bicarbonate", 23.0, 29.0, 23.0, 29.0),
    ("ALT", 7.0, 35.0, 7.0, 35.0),
    ("AST", 10.0, 40.0, 10.0, 40.0),
    ("Alkaline phosphatase", 30.0, 120.0, 30.0, 120.0),
    ("Total bilirubin", 0.1, 1.2, 0.1, 1.2),
    ("Albumin", 3.5, 5.0, 3.5, 5.0),
)


def generic_ranges(spark) -> DataFrame:
    """(analyte, gender, low, high): two rows per analyte, 36 in all."""
    rows = [(a, g, lo, hi) for a, ml, mh, fl, fh in GENERIC_LAB_RANGES for g, lo, hi in (("M", ml, mh), ("F", fl, fh))]
    return spark.createDataFrame(rows, "analyte string, gender string, generic_low double, generic_high double")


def lab_range_flags(labevents: DataFrame, analytes: DataFrame, patients: DataFrame) -> DataFrame:
    """Flag each numeric lab result low / high / normal. The dataset's own
    reference range takes precedence when either bound is present; otherwise
    the generic range for the analyte and the patient's sex applies. The
    generic table has a fixed 36 rows, so it is broadcast; the patient join is
    a key join Spark plans by size."""
    ranges = F.broadcast(generic_ranges(labevents.sparkSession))
    le = labevents.select("subject_id", "hadm_id", "itemid", "charttime", "valuenum",
                          "ref_range_lower", "ref_range_upper")
    j = (le.join(analytes.select("itemid", "analyte"), "itemid", "left")
         .join(patients.select("subject_id", "gender"), "subject_id", "left")
         .join(ranges, ["analyte", "gender"], "left"))
    own = F.col("ref_range_lower").isNotNull() | F.col("ref_range_upper").isNotNull()
    low = F.when(own, F.col("ref_range_lower")).otherwise(F.col("generic_low"))
    high = F.when(own, F.col("ref_range_upper")).otherwise(F.col("generic_high"))
    src = F.when(own, F.lit("dataset")).when(F.col("generic_low").isNotNull(), F.lit("generic"))
    v = F.col("valuenum")
    flag = (F.when(v.isNull() | src.isNull(), F.lit(None))
            .when(low.isNotNull() & (v < low), F.lit("low"))
            .when(high.isNotNull() & (v > high), F.lit("high")).otherwise(F.lit("normal")))
    return j.select("subject_id", "hadm_id", "itemid", "charttime", "valuenum", "analyte",
                    low.alias("range_low"), high.alias("range_high"), src.alias("range_source"),
                    flag.alias("range_flag"))


def anion_gap(labevents: DataFrame, analytes: DataFrame) -> DataFrame:
    """Per admission: the latest sodium, chloride and bicarbonate results and
    the anion gap Na − (Cl + HCO₃) when all three exist. "Latest" is by chart
    time, then the larger value, so the pick is deterministic; each admission
    aggregates with map-side partials."""
    names = {"Sodium": "sodium", "Chloride": "chloride", "Bicarbonate": "bicarbonate"}
    le = (labevents.filter(F.col("valuenum").isNotNull() & F.col("charttime").isNotNull())
          .join(analytes.filter(F.col("analyte").isin(*names)).select("itemid", "analyte"), "itemid")
          .select("hadm_id", "subject_id", "analyte", "charttime", "valuenum"))
    aggs = [F.max_by(F.when(F.col("analyte") == a, F.col("valuenum")),
                     F.when(F.col("analyte") == a, F.struct("charttime", "valuenum"))).alias(c)
            for a, c in names.items()]
    g = le.groupBy("hadm_id", "subject_id").agg(*aggs)
    return g.withColumn("anion_gap", F.round(F.col("sodium") - (F.col("chloride") + F.col("bicarbonate")), 6))


# --- blood-pressure class -------------------------------------------------------

def bp_class(systolic: str, diastolic: str) -> Column:
    """US adult hypertension class of one reading (mmHg), most severe first:
    crisis ≥180/≥120, stage 2 ≥140/≥90, stage 1 130–139/80–89, elevated
    120–129 with diastolic <80, else normal. NULL if either value is missing."""
    s, d = F.col(systolic), F.col(diastolic)
    return (F.when(s.isNull() | d.isNull(), F.lit(None))
            .when((s >= 180) | (d >= 120), F.lit("Hypertensive crisis"))
            .when((s >= 140) | (d >= 90), F.lit("Stage 2 hypertension"))
            .when((s >= 130) | (d >= 80), F.lit("Stage 1 hypertension"))
            .when(s >= 120, F.lit("Elevated")).otherwise(F.lit("Normal")))


def bp_classification(readings: DataFrame) -> DataFrame:
    """Pair systolic and diastolic readings charted for the same stay at the
    same time (the higher value if one is charted twice) and classify each
    pair. ``readings``: stay_id, subject_id, charttime, measure, value."""
    g = readings.groupBy("stay_id", "subject_id", "charttime").agg(
        F.max(F.when(F.col("measure") == "systolic", F.col("value"))).alias("systolic"),
        F.max(F.when(F.col("measure") == "diastolic", F.col("value"))).alias("diastolic"))
    pairs = g.filter(F.col("systolic").isNotNull() & F.col("diastolic").isNotNull())
    return pairs.withColumn("bp_class", bp_class("systolic", "diastolic"))


# --- net promoter score -------------------------------------------------------------

def net_promoter_score(responses: DataFrame, period: Column) -> DataFrame:
    """Per period: respondents, promoters (9–10), passives (7–8), detractors
    (0–6) and NPS = % promoters − % detractors. Scores outside 0–10 are ignored."""
    r = responses.filter(F.col("score").between(0, 10)).withColumn("period", period)
    g = r.groupBy("period").agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count_if(F.col("score") >= 9).alias("promoters"),
        F.count_if(F.col("score").between(7, 8)).alias("passives"),
        F.count_if(F.col("score") <= 6).alias("detractors"))
    return g.withColumn("nps", F.round((F.col("promoters") - F.col("detractors")) * 100.0 / F.col("respondents"), 6))
