"""Record bundle and rendering (Q13, Q14) and prompt assembly (R2).

The reference issues 11 queries per subject and builds the text in Python.
Here every part is ranked for all subjects at once (bounded to k rows per
subject before anything is gathered), each row is rendered to its line with
built-in string expressions, and one aggregation per subject stitches the
sections together in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import records

# The rule line and section headings of the rendered record.
RULE = "═" * 79
SECTION_HEADINGS = (
    "RECENT HOSPITAL ADMISSIONS:\n",
    "DIAGNOSES (ICD-10 Codes with Descriptions):\n",
    "PROCEDURES PERFORMED:\n",
    "RECENT LABORATORY RESULTS:\n",
    "PRESCRIBED MEDICATIONS:\n",
    "MEDICATION ADMINISTRATION RECORDS (eMAR):\n",
    "PROVIDER ORDERS (POE):\n",
    "INTENSIVE CARE UNIT STAYS:\n",
    "   Recent ICU Vital Signs:\n",
    "   ICU Fluid/Medication Inputs:\n",
)
# Rows fetched per part for the record, and rows shown.
RECORD_K = {"admissions": 3, "diagnoses": 8, "procedures": 5, "labs": 12, "medications": 10,
            "med_admin": 8, "orders": 5, "icu_stays": None, "vitals": 15, "inputs": 8}
SHOWN = {"vitals": 10, "inputs": 8}


@dataclass
class RecordParts:
    profile: DataFrame
    admissions: DataFrame
    diagnoses: DataFrame
    procedures: DataFrame
    labs: DataFrame
    medications: DataFrame
    med_admin: DataFrame
    orders: DataFrame
    icu_stays: DataFrame
    vitals: DataFrame
    inputs: DataFrame


def record_parts(patients, admissions, drgcodes, diagnoses, d_icd_diagnoses, procedures, d_icd_procedures,
                 labevents, d_labitems, prescriptions, emar, poe, icustays, chartevents, d_items,
                 inputevents, tasks: int | None = None) -> RecordParts:
    """Q13 part 1: the 11 retrievals for every subject, with the record's k. With ``tasks`` every
    part is left dealt by subject to that many tasks, so that gathering them moves no row again;
    a subject's events then pass one task, so leave it out when one subject holds very many."""
    k = RECORD_K
    return RecordParts(
        profile=records.subject_profile(patients, admissions, diagnoses, icustays, prescriptions),
        admissions=records.dealt(records.recent_admissions(admissions, drgcodes, k["admissions"]), tasks),
        diagnoses=records.diagnosis_counts(diagnoses, d_icd_diagnoses, admissions, k["diagnoses"], tasks),
        procedures=records.procedure_history(procedures, d_icd_procedures, k["procedures"], tasks),
        labs=records.dealt(records.recent_labs(labevents, d_labitems, k["labs"]), tasks),
        medications=records.recent_prescriptions(prescriptions, k["medications"]),
        med_admin=records.dealt(records.medication_administrations(emar, k["med_admin"]), tasks),
        orders=records.dealt(records.provider_orders(poe, k["orders"]), tasks),
        icu_stays=records.dealt(records.icu_stays(icustays), tasks),
        vitals=records.recent_vitals(chartevents, d_items, k["vitals"], tasks),
        inputs=records.dealt(records.icu_inputs(inputevents, d_items, k["inputs"]), tasks),
    )


_PART_NAMES = ["admissions", "diagnoses", "procedures", "labs", "medications", "med_admin", "orders",
               "icu_stays", "vitals", "inputs"]


def record_bundle(parts: RecordParts) -> DataFrame:
    """Q13: one wide row per subject — the profile plus each part as an array
    of structs in rank order (``part_<name>``). Each array holds at most k
    rows (ICU stays: all of the subject's stays, as in the reference).

    The ranked rows of all parts are tagged with their section and gathered by one
    aggregate and joined to the profile once, instead of once for each part."""
    kinds = {name: getattr(parts, name).schema for name in _PART_NAMES}

    def payload(name: str) -> list[str]:
        return ["rn", *[c for c in kinds[name].names if c not in ("subject_id", "rn")]]

    def tagged(name: str) -> DataFrame:
        empty = [F.lit(None).cast(T.StructType([kinds[n][c] for c in payload(n)])).alias(f"part_{n}") if n != name
                 else F.struct(*payload(n)).alias(f"part_{n}") for n in _PART_NAMES]
        return getattr(parts, name).select("subject_id", *empty)
    rows = reduce(DataFrame.unionByName, map(tagged, _PART_NAMES))
    # collect_list leaves the other sections' rows out, which are NULL in this section's column
    gathered = rows.groupBy("subject_id").agg(*[F.array_sort(F.collect_list(f"part_{n}")).alias(f"part_{n}") for n in _PART_NAMES])
    out = parts.profile.join(gathered, "subject_id", "left")
    return out.select(*parts.profile.columns, *[F.coalesce(f"part_{n}", F.array().cast(out.schema[f"part_{n}"].dataType)).alias(f"part_{n}")
                                                for n in _PART_NAMES])


# --- line rendering (§2.2.1) -------------------------------------------------------

def _s(c) -> Column:
    return S.py_str(c)


def _or(c: str, fallback: str) -> Column:
    """Python ``x or 'fallback'`` for a string column."""
    return F.when(S.truthy_str(c), F.col(c)).otherwise(F.lit(fallback))


def _ts(c: str, fmt: str) -> Column:
    return F.coalesce(F.date_format(c, fmt), F.lit("Unknown"))


def _num_text(c: str) -> Column:
    """``f"{x}"`` of a float: plain digits from 1e-4 up to 1e16, else a two-digit exponent."""
    text = F.col(c).cast("string")
    size = F.abs(F.col(c))
    plain = F.regexp_replace(F.col(c).cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), "\\.0$", ""), F.lit("e"),
                     F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    short = F.when(F.abs(power) > 99, F.concat(F.regexp_replace(F.substring_index(text, "E", 1), "\\.0$", ""), F.lit("e"),
                                               F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(short)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def _los(c: str) -> Column:
    return F.when(S.truthy_num(c), F.concat(S.fmt_1f(F.col(c)), F.lit(" days"))).otherwise(F.lit("Ongoing"))


def _title(c: str) -> Column:
    t = F.when(S.truthy_str(c) & (F.char_length(c) > 70), F.concat(F.substring(c, 1, 70), F.lit("...")))\
        .otherwise(F.col(c))
    return F.when(t.isNotNull() & (t != ""), t).otherwise(F.lit("N/A"))


def _n(rn: str = "rn") -> Column:
    return F.concat(F.col(rn).cast("string"), F.lit(". "))


def _item(df: DataFrame, section: int, line: Column) -> DataFrame:
    return df.select("subject_id", F.lit(section).alias("section"), F.col("rn").cast("int").alias("rn"),
                     line.alias("line"))


def item_lines(parts: RecordParts) -> DataFrame:
    """(subject_id, section, rn, line) for every rendered item."""
    a = parts.admissions
    drg = F.when(S.truthy_str("drg_code"), F.concat(
        F.lit("\n   DRG: "), _s("drg_code"), F.lit(" - "), _s("drg_description"),
        F.when(S.truthy_num("drg_severity"), F.concat(
            F.lit(" (Severity: "), _s("drg_severity"), F.lit(", Mortality Risk: "), _s("drg_mortality"), F.lit(")")))
        .otherwise(F.lit("")))).otherwise(F.lit(""))
    adm = _item(a, 1, F.concat(
        _n(), _s("admission_type"), F.lit(" admission on "), _s(F.date_format("admittime", "yyyy-MM-dd")),
        F.lit("\n   Location: "), _s("admission_location"), F.lit(" → "), _s("discharge_location"),
        F.lit("\n   LOS: "), _los("los_days"), F.lit(", Insurance: "), _s("insurance"), drg, F.lit("\n")))

    d = parts.diagnoses
    prio = F.when(S.truthy_num("seq_num"), F.concat(F.lit("[Seq "), _s("seq_num"), F.lit("]"))).otherwise(F.lit(""))
    dx = _item(d, 2, F.concat(_n(), _s("icd_code"), F.lit(" "), prio, F.lit(" - "), _title("long_title"),
                              F.lit(" ("), _s("occurrence_count"), F.lit("x)\n")))

    p = parts.procedures
    px = _item(p, 3, F.concat(_n(), _s("icd_code"), F.lit(" - "), _title("long_title"), F.lit(" (Date: "),
                              _ts("chartdate", "yyyy-MM-dd"), F.lit(")\n")))

    lab = parts.labs
    value = (F.when(S.truthy_str("value"), F.col("value"))
             .when(S.truthy_num("valuenum"), _num_text("valuenum")).otherwise(F.lit("N/A")))
    ref = F.when(S.truthy_num("ref_range_lower") | S.truthy_num("ref_range_upper"), F.concat(
        F.lit(" (Ref: "), F.when(S.truthy_num("ref_range_lower"), _num_text("ref_range_lower")).otherwise(F.lit("?")),
        F.lit("-"), F.when(S.truthy_num("ref_range_upper"), _num_text("ref_range_upper")).otherwise(F.lit("?")),
        F.lit(")"))).otherwise(F.lit(""))
    flag = F.when(S.truthy_str("flag") & (F.lower("flag") == "abnormal"), F.concat(F.lit("  ABNORMAL"), ref))\
        .otherwise(F.lit(""))
    labs = _item(lab, 4, F.concat(
        _n(), _or("label", "Lab Test"), F.lit(" "),
        F.when(S.truthy_str("category"), F.concat(F.lit("["), F.col("category"), F.lit("]"))).otherwise(F.lit("")),
        F.lit(": "), value, F.lit(" "), _or("valueuom", ""), flag, F.lit(" ("),
        _ts("charttime", "yyyy-MM-dd HH:mm"), F.lit(")\n")))

    m = parts.medications
    rx = _item(m, 5, F.concat(
        _n(), _s("drug"), F.lit(" "),
        F.when(S.truthy_str("dose_val_rx"), F.concat(F.col("dose_val_rx"), F.lit(" "), _s("dose_unit_rx")))
        .otherwise(F.lit("")), F.lit(" "),
        F.when(S.truthy_str("route"), F.concat(F.lit("via "), F.col("route"))).otherwise(F.lit("")), F.lit(" "),
        F.when(S.truthy_str("drug_type"), F.concat(F.lit("["), F.col("drug_type"), F.lit("]"))).otherwise(F.lit("")),
        F.lit(" (Started: "), _ts("starttime", "yyyy-MM-dd"), F.lit(")\n")))

    e = parts.med_admin
    emar = _item(e, 6, F.concat(_n(), _s("medication"), F.lit(" - "), _or("event_txt", "Administered"),
                                F.lit(" ("), _ts("charttime", "yyyy-MM-dd HH:mm"), F.lit(")\n")))

    o = parts.orders
    otype = F.concat(_or("order_type", "Order"), F.when(S.truthy_str("order_subtype"),
                                                        F.concat(F.lit(" - "), F.col("order_subtype")))
                     .otherwise(F.lit("")))
    poe = _item(o, 7, F.concat(
        _n(), otype, F.lit(" ["), _or("order_status", "Unknown"), F.lit("]"),
        F.when(S.truthy_str("order_provider_id"), F.concat(F.lit(" by "), F.col("order_provider_id")))
        .otherwise(F.lit("")), F.lit(" ("), _ts("ordertime", "yyyy-MM-dd HH:mm"), F.lit(")\n")))

    s = parts.icu_stays
    icu = _item(s, 8, F.concat(
        _n(), F.lit("ICU Stay ID "), _s("stay_id"), F.lit(": "), _s("first_careunit"), F.lit(" → "),
        _s("last_careunit"), F.lit("\n   Admitted: "), _ts("intime", "yyyy-MM-dd HH:mm"), F.lit(", LOS: "),
        _los("los_days"), F.lit("\n")))

    # Vitals and inputs are printed only inside the ICU section.
    with_stays = s.select("subject_id").distinct()
    v = parts.vitals.filter(F.col("rn") <= SHOWN["vitals"]).join(with_stays, "subject_id", "left_semi")
    vvalue = (F.when(S.truthy_str("value"), F.col("value"))
              .when(S.truthy_num("valuenum"), _num_text("valuenum")).otherwise(F.lit("N/A")))
    vit = _item(v, 9, F.concat(
        F.lit("   • "), _s("label"), F.lit(": "), vvalue, F.lit(" "), _or("valueuom", ""),
        F.when(F.col("status") == "Warning", F.concat(F.lit(" ["), F.col("status"), F.lit("]"))).otherwise(F.lit("")),
        F.lit(" ("), _ts("charttime", "yyyy-MM-dd HH:mm"), F.lit(")\n")))

    i = parts.inputs.filter(F.col("rn") <= SHOWN["inputs"]).join(with_stays, "subject_id", "left_semi")
    inp = _item(i, 10, F.concat(
        F.lit("   • "), _s("label"), F.lit(" ("), _or("ordercategoryname", "Unknown"), F.lit("): "),
        F.when(S.truthy_num("amount"), F.concat(_num_text("amount"), F.lit(" "), _s("amountuom"))).otherwise(F.lit("")),
        F.lit(" "),
        F.when(S.truthy_num("rate"), F.concat(F.lit("@ "), _num_text("rate"), F.lit(" "), _s("rateuom")))
        .otherwise(F.lit("")),
        F.lit(" (Started: "), _ts("starttime", "yyyy-MM-dd HH:mm"), F.lit(")\n")))

    return adm.unionByName(dx).unionByName(px).unionByName(labs).unionByName(rx).unionByName(emar) \
        .unionByName(poe).unionByName(icu).unionByName(vit).unionByName(inp)


def header(profile: DataFrame) -> Column:
    return F.concat(
        F.lit("\n" + RULE + "\nPATIENT CLINICAL RECORD (Subject ID: "), _s("subject_id"), F.lit(")\n" + RULE + "\n\n"),
        F.lit("DEMOGRAPHICS & SUMMARY:\n├─ Gender: "), _s("gender"),
        F.lit("\n├─ Age: "), _s("anchor_age"), F.lit(" years\n├─ Year Group: "), _s("anchor_year_group"),
        F.lit("\n├─ Status: "), _s("status"), F.lit("\n├─ Total Hospital Admissions: "), _s("total_admissions"),
        F.lit("\n├─ ICU Stays: "), _s("icu_stays"), F.lit("\n├─ Unique Diagnoses: "), _s("unique_diagnoses"),
        F.lit("\n└─ Unique Medications: "), _s("unique_medications"), F.lit("\n\n"))


def render_records(parts: RecordParts, tasks: int | None = None) -> DataFrame:
    """Q14: (subject_id, record) — the text record for every subject. With ``tasks`` the
    lines and the profiles are dealt by subject to that many tasks first.

    One aggregation per subject: items are sorted by (section, rank); a
    section heading is emitted before the first item of a section and a blank
    line after its last, so empty sections vanish as in the reference.
    """
    items = records.dealt(item_lines(parts), tasks)
    headings = F.array(*[F.lit(h) for h in SECTION_HEADINGS])
    agg = items.groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.struct("section", "rn", "line"))).alias("_a"))

    def piece(x, i):
        prev = F.try_element_at(F.col("_a"), F.greatest(i, F.lit(1)))
        nxt = F.try_element_at(F.col("_a"), i + 2)
        first = (i == 0) | (prev["section"] != x["section"])
        last = nxt.isNull() | (nxt["section"] != x["section"])
        return F.concat(F.when(first, F.element_at(headings, x["section"])).otherwise(F.lit("")), x["line"],
                        F.when(last, F.lit("\n")).otherwise(F.lit("")))

    body = agg.select("subject_id", F.array_join(F.transform("_a", piece), "").alias("_body"))
    prof = records.dealt(parts.profile, tasks)
    return prof.join(body, "subject_id", "left").select(
        "subject_id", F.concat(header(prof), F.coalesce("_body", F.lit("")), F.lit(RULE + "\n")).alias("record"))


# --- R2 --------------------------------------------------------------------------------

# The prompt's follow-up blocks.
FOLLOW_UP_HEADER = (RULE + "\n CONVERSATION CONTEXT (User is asking a follow-up question)\n" + RULE + "\n\n")
DATE_HINT_TAIL = ("The current question likely refers to events on or around these dates.\n"
                  "CHECK THE PATIENT'S MEDICATION DATA BELOW FOR THESE DATES.\n\n")
FOLLOW_UP_INSTRUCTIONS = (
    "  CRITICAL INSTRUCTIONS:\n"
    "- This is a FOLLOW-UP question referring to the previous conversation\n"
    "- Words like 'this', 'that', 'said procedure' refer to information from the previous answer\n"
    "- USE THE PATIENT'S ACTUAL MEDICATION DATA shown in the clinical record above\n"
    "- DO NOT say 'no information available' if medications are listed in the patient record\n"
    "- Look at PRESCRIBED MEDICATIONS and MEDICATION ADMINISTRATION RECORDS sections\n")


def build_prompts(questions: DataFrame, records_df: DataFrame) -> DataFrame:
    """R2: one prompt per question row (``subject_id``, ``question``,
    ``prev_question``, ``prev_answer``) joined to the subject's record.

    The date hint lists the distinct dates of the previous answer, sorted
    (the reference prints a Python set, whose order is arbitrary).
    """
    has_prev = F.col("prev_answer").isNotNull()
    dates = F.array_join(S.extract_dates(F.col("prev_answer")), ", ")
    prev_block = F.when(has_prev, F.concat(
        F.lit(FOLLOW_UP_HEADER), F.lit("Previous Question: "), _s("prev_question"), F.lit("\n\n"),
        F.lit("Previous Answer:\n"), F.col("prev_answer"), F.lit("\n\n"), F.lit(RULE + "\n\n"),
        F.when(F.size(S.extract_dates(F.col("prev_answer"))) > 0, F.concat(
            F.lit("  IMPORTANT: The previous answer mentioned dates: "), dates, F.lit("\n"), F.lit(DATE_HINT_TAIL)))
        .otherwise(F.lit("")))).otherwise(F.lit(""))
    j = questions.join(records_df, "subject_id", "left")
    prompt = F.concat(prev_block, F.coalesce(F.col("record"), F.lit("")),
                      F.lit("\n" + RULE + "\nCURRENT QUESTION: "), _s("question"), F.lit("\n" + RULE + "\n\n"),
                      F.when(has_prev, F.lit(FOLLOW_UP_INSTRUCTIONS)).otherwise(F.lit("")))
    return j.withColumn("prompt", prompt).drop("record")
