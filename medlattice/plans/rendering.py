"""Record bundle, rendered record and prompt bindings (Q13, Q14, R2), with a
SQL renderer as the oracle (string_agg in rank order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators import records
from ..operators import render as R
from .bindings import ClinicalTables, with_ctes
from .catalog import _topk_sql, register

_PART_TABLES = ["patients", "admissions", "drgcodes", "diagnoses_icd", "d_icd_diagnoses", "procedures_icd",
                "d_icd_procedures", "labevents", "d_labitems", "prescriptions", "emar", "poe", "icustays",
                "chartevents", "d_items", "inputevents"]


def parts_for(t: ClinicalTables, subjects: DataFrame | None = None) -> R.RecordParts:
    """The 11 retrievals; with ``subjects`` every input is semi-joined first,
    so a prompt batch for a few subjects never ranks everyone's events. The bound
    events are joined and written once, not once for each of the six event roles, and only
    for these subjects. A batch's parts are each ranked in tasks of their own and dealt by
    subject as lines, so that no task holds the buffers of all of them; without ``subjects``
    the lines are too many to move again, and all parts stay by subject."""
    tasks = t.bind_events_once(subjects)

    def sub(df: DataFrame) -> DataFrame:
        return df if subjects is None else df.join(subjects, "subject_id", "left_semi")
    return R.record_parts(
        sub(t.patients), sub(t.admissions), t.drgcodes, t.diagnoses_icd, t.d_icd_diagnoses,
        t.procedures_icd, t.d_icd_procedures, t.labevents, t.d_labitems, t.prescriptions,
        sub(t.emar), sub(t.poe), sub(t.icustays), t.chartevents, t.d_items, t.inputevents, tasks if subjects is None else None)


# --- SQL twins of the render helpers -------------------------------------------------

def _s(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def _ts(x: str, fmt: str) -> str:
    return f"coalesce(strftime({x}, '{fmt}'), 'Unknown')"


def _tstr(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def _tnum(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> 0)"


def _or(x: str, fb: str) -> str:
    return f"CASE WHEN {_tstr(x)} THEN {x} ELSE '{fb}' END"


def _los(x: str) -> str:
    return f"CASE WHEN {_tnum(x)} THEN printf('%.1f', {x}) || ' days' ELSE 'Ongoing' END"


def _title(x: str) -> str:
    t = f"CASE WHEN {_tstr(x)} AND length({x}) > 70 THEN substring({x}, 1, 70) || '...' ELSE {x} END"
    return f"coalesce(nullif({t}, ''), 'N/A')"


NL = "chr(10)"
ADMIT_DAY = "strftime(admittime, '%Y-%m-%d')"


def _parts_sql() -> list[tuple[str, str]]:
    k = R.RECORD_K
    A, DRG = records.ADMISSION_COLS, records.DRG_COLS
    adm = _topk_sql(
        """SELECT a.subject_id, a.hadm_id, a.admittime, a.dischtime, a.admission_type, a.admission_location,
           a.discharge_location, a.insurance, a.race, epoch(a.dischtime - a.admittime) / 86400 AS los_days,
           d.drg_code, d.description AS drg_description, d.drg_severity, d.drg_mortality
           FROM admissions a LEFT JOIN drgcodes d ON a.hadm_id = d.hadm_id""",
        "admittime DESC NULLS FIRST", A[:1] + A[2:] + DRG, "*", k["admissions"])
    dx = _topk_sql(
        """SELECT d.subject_id, d.icd_code, d.icd_version, dd.long_title, d.seq_num, count(*) AS occurrence_count,
           max(a.admittime) AS most_recent FROM diagnoses_icd d
           LEFT JOIN d_icd_diagnoses dd ON d.icd_code = dd.icd_code AND d.icd_version = dd.icd_version
           LEFT JOIN admissions a ON d.hadm_id = a.hadm_id
           GROUP BY d.subject_id, d.icd_code, d.icd_version, dd.long_title, d.seq_num""",
        "occurrence_count DESC NULLS FIRST, seq_num ASC NULLS LAST",
        ["icd_code", "icd_version", "long_title", "most_recent"], "*", k["diagnoses"])
    px = _topk_sql(
        """SELECT p.subject_id, p.icd_code, dp.long_title, p.chartdate, count(*) AS occurrence_count
           FROM procedures_icd p LEFT JOIN d_icd_procedures dp
             ON p.icd_code = dp.icd_code AND p.icd_version = dp.icd_version
           GROUP BY p.subject_id, p.icd_code, dp.long_title, p.chartdate""",
        "chartdate DESC NULLS FIRST", ["icd_code", "long_title", "occurrence_count"], "*", k["procedures"])
    labs = ("SELECT r.*, li.label, li.fluid, li.category FROM (" + _topk_sql(
        "SELECT * FROM labevents WHERE charttime IS NOT NULL", "charttime DESC NULLS FIRST",
        records.LAB_EVENT_COLS, "*", k["labs"]) + ") r LEFT JOIN d_labitems li ON r.itemid = li.itemid")
    rx = _topk_sql("SELECT * FROM prescriptions WHERE drug IS NOT NULL", "starttime DESC NULLS FIRST",
                   [c for c in records.RX_COLS if c != "starttime"], "*", k["medications"])
    emar = _topk_sql("SELECT * FROM emar WHERE medication IS NOT NULL", "charttime DESC NULLS FIRST",
                     records.EMAR_COLS[1:], "*", k["med_admin"])
    poe = _topk_sql("SELECT * FROM poe", "ordertime DESC NULLS FIRST",
                    [c for c in records.POE_COLS if c != "ordertime"], "*", k["orders"])
    icu = _topk_sql("SELECT subject_id, stay_id, hadm_id, first_careunit, last_careunit, intime, "
                    "CAST(NULL AS TIMESTAMP) AS outtime, los AS los_days FROM icustays",
                    "intime DESC NULLS FIRST", [c for c in records.ICU_COLS if c != "intime"], "*", None)
    vit = _topk_sql(
        """SELECT ce.subject_id, ce.itemid, ce.charttime, di.label, di.category, ce.value, ce.valuenum, ce.valueuom,
           CASE WHEN ce.warning = 1 THEN 'Warning' ELSE 'Normal' END AS status
           FROM chartevents ce JOIN d_items di ON ce.itemid = di.itemid
           WHERE di.category IN ('Vital Signs', 'Labs', 'Respiratory')""",
        "charttime DESC NULLS FIRST", ["itemid", "label", "category", "value", "valuenum", "valueuom", "status"],
        "*", k["vitals"])
    inp = ("SELECT r.*, di.label FROM (" + _topk_sql(
        "SELECT * FROM inputevents", "starttime DESC NULLS FIRST",
        [c for c in records.INPUT_COLS if c != "starttime"], "*", k["inputs"])
        + ") r LEFT JOIN d_items di ON r.itemid = di.itemid")
    return [("p_adm", adm), ("p_dx", dx), ("p_px", px), ("p_labs", labs), ("p_rx", rx), ("p_emar", emar),
            ("p_poe", poe), ("p_icu", icu), ("p_vit", vit), ("p_inp", inp)]


def _items_sql() -> str:
    n = "CAST(rn AS VARCHAR) || '. '"
    drg = (f"CASE WHEN {_tstr('drg_code')} THEN {NL} || '   DRG: ' || {_s('drg_code')} || ' - ' || "
           f"{_s('drg_description')} || CASE WHEN {_tnum('drg_severity')} THEN ' (Severity: ' || {_s('drg_severity')}"
           f" || ', Mortality Risk: ' || {_s('drg_mortality')} || ')' ELSE '' END ELSE '' END")
    adm = (f"SELECT subject_id, 1 AS section, rn, {n} || {_s('admission_type')} || ' admission on ' || "
           f"{_s(ADMIT_DAY)} || {NL} || '   Location: ' || "
           f"{_s('admission_location')} || ' → ' || {_s('discharge_location')} || {NL} || '   LOS: ' || "
           f"{_los('los_days')} || ', Insurance: ' || {_s('insurance')} || {drg} || {NL} AS line FROM p_adm")
    dx = (f"SELECT subject_id, 2, rn, {n} || {_s('icd_code')} || ' ' || CASE WHEN {_tnum('seq_num')} THEN "
          f"'[Seq ' || {_s('seq_num')} || ']' ELSE '' END || ' - ' || {_title('long_title')} || ' (' || "
          f"{_s('occurrence_count')} || 'x)' || {NL} FROM p_dx")
    px = (f"SELECT subject_id, 3, rn, {n} || {_s('icd_code')} || ' - ' || {_title('long_title')} || ' (Date: ' || "
          f"{_ts('chartdate', '%Y-%m-%d')} || ')' || {NL} FROM p_px")
    value = (f"CASE WHEN {_tstr('value')} THEN value WHEN {_tnum('valuenum')} THEN CAST(valuenum AS VARCHAR) "
             f"ELSE 'N/A' END")
    ref = (f"CASE WHEN {_tnum('ref_range_lower')} OR {_tnum('ref_range_upper')} THEN ' (Ref: ' || "
           f"CASE WHEN {_tnum('ref_range_lower')} THEN CAST(ref_range_lower AS VARCHAR) ELSE '?' END || '-' || "
           f"CASE WHEN {_tnum('ref_range_upper')} THEN CAST(ref_range_upper AS VARCHAR) ELSE '?' END || ')' ELSE '' END")
    labs = (f"SELECT subject_id, 4, rn, {n} || {_or('label', 'Lab Test')} || ' ' || CASE WHEN {_tstr('category')} "
            f"THEN '[' || category || ']' ELSE '' END || ': ' || {value} || ' ' || {_or('valueuom', '')} || "
            f"CASE WHEN {_tstr('flag')} AND lower(flag) = 'abnormal' THEN '  ABNORMAL' || {ref} ELSE '' END || "
            f"' (' || {_ts('charttime', '%Y-%m-%d %H:%M')} || ')' || {NL} FROM p_labs")
    rx = (f"SELECT subject_id, 5, rn, {n} || {_s('drug')} || ' ' || CASE WHEN {_tstr('dose_val_rx')} THEN "
          f"dose_val_rx || ' ' || {_s('dose_unit_rx')} ELSE '' END || ' ' || CASE WHEN {_tstr('route')} THEN "
          f"'via ' || route ELSE '' END || ' ' || CASE WHEN {_tstr('drug_type')} THEN '[' || drug_type || ']' "
          f"ELSE '' END || ' (Started: ' || {_ts('starttime', '%Y-%m-%d')} || ')' || {NL} FROM p_rx")
    emar = (f"SELECT subject_id, 6, rn, {n} || {_s('medication')} || ' - ' || {_or('event_txt', 'Administered')} || "
            f"' (' || {_ts('charttime', '%Y-%m-%d %H:%M')} || ')' || {NL} FROM p_emar")
    poe = (f"SELECT subject_id, 7, rn, {n} || {_or('order_type', 'Order')} || CASE WHEN {_tstr('order_subtype')} "
           f"THEN ' - ' || order_subtype ELSE '' END || ' [' || {_or('order_status', 'Unknown')} || ']' || "
           f"CASE WHEN {_tstr('order_provider_id')} THEN ' by ' || order_provider_id ELSE '' END || ' (' || "
           f"{_ts('ordertime', '%Y-%m-%d %H:%M')} || ')' || {NL} FROM p_poe")
    icu = (f"SELECT subject_id, 8, rn, {n} || 'ICU Stay ID ' || {_s('stay_id')} || ': ' || {_s('first_careunit')} || "
           f"' → ' || {_s('last_careunit')} || {NL} || '   Admitted: ' || {_ts('intime', '%Y-%m-%d %H:%M')} || "
           f"', LOS: ' || {_los('los_days')} || {NL} FROM p_icu")
    vit = (f"SELECT subject_id, 9, rn, '   • ' || {_s('label')} || ': ' || {value} || ' ' || {_or('valueuom', '')} || "
           f"CASE WHEN status = 'Warning' THEN ' [' || status || ']' ELSE '' END || ' (' || "
           f"{_ts('charttime', '%Y-%m-%d %H:%M')} || ')' || {NL} FROM p_vit "
           f"WHERE rn <= {R.SHOWN['vitals']} AND subject_id IN (SELECT subject_id FROM p_icu)")
    inp = (f"SELECT subject_id, 10, rn, '   • ' || {_s('label')} || ' (' || {_or('ordercategoryname', 'Unknown')} || "
           f"'): ' || CASE WHEN {_tnum('amount')} THEN CAST(amount AS VARCHAR) || ' ' || {_s('amountuom')} ELSE '' END"
           f" || ' ' || CASE WHEN {_tnum('rate')} THEN '@ ' || CAST(rate AS VARCHAR) || ' ' || {_s('rateuom')} "
           f"ELSE '' END || ' (Started: ' || {_ts('starttime', '%Y-%m-%d %H:%M')} || ')' || {NL} FROM p_inp "
           f"WHERE rn <= {R.SHOWN['inputs']} AND subject_id IN (SELECT subject_id FROM p_icu)")
    return " UNION ALL ".join([adm, dx, px, labs, rx, emar, poe, icu, vit, inp])


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _profile_sql(latest: bool = False) -> str:
    return f"""SELECT p.subject_id, p.gender, p.anchor_age, p.anchor_year_group,
  coalesce(a.n, 0) AS total_admissions, coalesce(d.n, 0) AS unique_diagnoses,
  coalesce(i.n, 0) AS icu_stays, coalesce(r.n, 0) AS unique_medications,
  CASE WHEN p.dod IS NOT NULL THEN 'Deceased' ELSE 'Living' END AS status
  {", a.latest AS most_recent_admission" if latest else ""}
FROM patients p
LEFT JOIN (SELECT subject_id, count(DISTINCT hadm_id) AS n, max(admittime) AS latest FROM admissions GROUP BY 1) a ON p.subject_id = a.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT icd_code) AS n FROM diagnoses_icd GROUP BY 1) d ON p.subject_id = d.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT stay_id) AS n FROM icustays GROUP BY 1) i ON p.subject_id = i.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT drug) AS n FROM prescriptions GROUP BY 1) r ON p.subject_id = r.subject_id"""


def _record_sql_ctes() -> tuple[tuple[str, str], ...]:
    headings = ", ".join(_sql_lit(h) for h in R.SECTION_HEADINGS)
    header = (f"{_sql_lit(chr(10) + R.RULE + chr(10) + 'PATIENT CLINICAL RECORD (Subject ID: ')} || "
              f"{_s('prof.subject_id')} || {_sql_lit(')' + chr(10) + R.RULE + chr(10) + chr(10))} || "
              f"{_sql_lit('DEMOGRAPHICS & SUMMARY:' + chr(10) + '├─ Gender: ')} || {_s('gender')} || "
              f"{_sql_lit(chr(10) + '├─ Age: ')} || {_s('anchor_age')} || {_sql_lit(' years' + chr(10) + '├─ Year Group: ')}"
              f" || {_s('anchor_year_group')} || {_sql_lit(chr(10) + '├─ Status: ')} || {_s('status')} || "
              f"{_sql_lit(chr(10) + '├─ Total Hospital Admissions: ')} || {_s('total_admissions')} || "
              f"{_sql_lit(chr(10) + '├─ ICU Stays: ')} || {_s('icu_stays')} || "
              f"{_sql_lit(chr(10) + '├─ Unique Diagnoses: ')} || {_s('unique_diagnoses')} || "
              f"{_sql_lit(chr(10) + '└─ Unique Medications: ')} || {_s('unique_medications')} || {NL} || {NL}")
    blocks = (f"SELECT subject_id, section, [{headings}][section] || string_agg(line, '' ORDER BY rn) || {NL} AS block "
              f"FROM items GROUP BY subject_id, section")
    recs = (f"SELECT prof.subject_id, {header} || coalesce(b.body, '') || {_sql_lit(R.RULE + chr(10))} AS record "
            f"FROM prof LEFT JOIN (SELECT subject_id, string_agg(block, '' ORDER BY section) AS body FROM blocks "
            f"GROUP BY subject_id) b ON prof.subject_id = b.subject_id")
    return tuple(_parts_sql()) + (("items", _items_sql()), ("prof", _profile_sql()), ("blocks", blocks),
                                  ("recs", recs))


@register("render_record", with_ctes("SELECT subject_id, record FROM recs", *_PART_TABLES,
                                     extra=_record_sql_ctes()))
def q_render_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.render_records(parts_for(ClinicalTables(spark, sf_dir)))


#: Output column -> (the part's CTE, its columns in order; times marked *, fractions marked
#: #). The stays' column is named apart from the profile's count of them.
_BUNDLE = {
    "admissions": ("p_adm", ("hadm_id", "admittime*", "dischtime*", "admission_type", "admission_location", "discharge_location", "insurance",
                             "race", "los_days#", "drg_code", "drg_description", "drg_severity", "drg_mortality")),
    "diagnoses": ("p_dx", ("icd_code", "icd_version", "long_title", "seq_num", "occurrence_count", "most_recent*")),
    "procedures": ("p_px", ("icd_code", "long_title", "chartdate*", "occurrence_count")),
    "labs": ("p_labs", ("charttime*", "label", "fluid", "category", "value", "valuenum#", "valueuom", "flag", "ref_range_lower#", "ref_range_upper#")),
    "medications": ("p_rx", ("drug", "drug_type", "route", "starttime*", "stoptime*", "dose_val_rx", "dose_unit_rx", "form_rx", "gsn", "ndc")),
    "med_admin": ("p_emar", ("charttime*", "medication", "event_txt", "scheduletime*")),
    "orders": ("p_poe", ("poe_id", "ordertime*", "order_type", "order_subtype", "transaction_type", "order_provider_id", "order_status")),
    "icu_stay_rows": ("p_icu", ("stay_id", "hadm_id", "first_careunit", "last_careunit", "intime*", "outtime*", "los_days#")),
    "vitals": ("p_vit", ("charttime*", "label", "category", "value", "valuenum#", "valueuom", "status")),
    "inputs": ("p_inp", ("starttime*", "endtime*", "label", "amount#", "amountuom", "rate#", "rateuom", "ordercategoryname", "statusdescription")),
}


def _bundle_sql() -> str:
    def text(c: str) -> str:
        if c.endswith("*"):
            return f"coalesce(strftime({c[:-1]}, '%Y-%m-%d %H:%M:%S'), '~')"
        if c.endswith("#"):
            return f"coalesce(CAST(CAST(round({c[:-1]} * 1000000) AS BIGINT) AS VARCHAR), '~')"
        return f"coalesce(CAST({c} AS VARCHAR), '~')"
    joins, cols = "", ""
    for name, (table, columns) in _BUNDLE.items():
        joins += (f" LEFT JOIN (SELECT subject_id, string_agg(concat_ws('|', {', '.join(map(text, columns))}), ';' ORDER BY rn) AS t FROM {table}"
                  f" GROUP BY subject_id) b_{table} ON b_{table}.subject_id = prof.subject_id")
        cols += f", coalesce(b_{table}.t, '') AS {name}"
    return ("SELECT prof.* EXCLUDE (most_recent_admission), strftime(most_recent_admission, '%Y-%m-%d %H:%M:%S')"
            f" AS most_recent_admission{cols} FROM prof{joins}")


@register("record_bundle", with_ctes(_bundle_sql(), *_PART_TABLES, extra=tuple(_parts_sql())
                                     + (("prof", _profile_sql(latest=True)),)))
def q_record_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle: the profile and, per part, its rows in rank order as text with every
    column of the part (fractions in millionths)."""
    b = R.record_bundle(parts_for(ClinicalTables(spark, sf_dir)))

    def text(x, c):
        if c.endswith("*"):
            return F.date_format(x[c[:-1]], "yyyy-MM-dd HH:mm:ss")
        return F.round(x[c[:-1]] * 1000000).cast("long").cast("string") if c.endswith("#") else x[c].cast("string")

    def row_text(columns):
        return lambda x: F.concat_ws("|", *[F.coalesce(text(x, c), F.lit("~")) for c in columns])
    parts = []
    for name, (_, columns) in _BUNDLE.items():
        part = "part_icu_stays" if name == "icu_stay_rows" else f"part_{name}"
        held = [f.name for f in b.schema[part].dataType.elementType.fields if f.name != "rn"]
        if sorted(held) != sorted(c.rstrip("*#") for c in columns):
            raise ValueError(f"{name}: the part holds {held}")      # no column may be left out
        parts.append(F.array_join(F.transform(part, row_text(columns)), ";").alias(name))
    return b.select("subject_id", "gender", "anchor_age", "anchor_year_group", "total_admissions",
                    "unique_diagnoses", "icu_stays", "unique_medications", "status",
                    F.date_format("most_recent_admission", "yyyy-MM-dd HH:mm:ss").alias("most_recent_admission"), *parts)


# --- R2 ------------------------------------------------------------------------------

_EXCHANGES_SQL = """SELECT conv_id, q_idx, min(turn) FILTER (WHERE role = 'user') AS turn,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
    arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer
  FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_idx
        FROM dated WHERE role IN ('user', 'assistant')) t
  WHERE q_idx > 0 GROUP BY conv_id, q_idx"""
# two of three turns mention dates, one of them twice
_DATED_SQL = """SELECT conv_id, turn, role, text || CASE WHEN turn % 3 = 0 THEN '' ELSE
    ' Seen on ' || strftime(DATE '2150-01-01' + CAST(conv_id * 3 + turn AS INTEGER), '%Y-%m-%d') || ' and on '
    || strftime(DATE '2150-01-01' + CAST(conv_id * 5 AS INTEGER), '%Y-%m-%d') || ', '
    || strftime(DATE '2150-01-01' + CAST(conv_id * 5 AS INTEGER), '%Y-%m-%d') || '.' END AS text FROM conversations"""


def _dated(conv: DataFrame) -> DataFrame:
    def day(n):
        return F.date_format(F.date_add(F.lit("2150-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    one, two = day(F.col("conv_id") * 3 + F.col("turn")), day(F.col("conv_id") * 5)
    seen = F.concat(F.col("text"), F.lit(" Seen on "), one, F.lit(" and on "), two, F.lit(", "), two, F.lit("."))
    return conv.withColumn("text", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(seen))


def _prompt_sql() -> str:
    dates = "array_to_string(list_sort(list_distinct(regexp_extract_all(prev_answer, '\\d{4}-\\d{2}-\\d{2}'))), ', ')"
    prev = (f"CASE WHEN prev_answer IS NOT NULL THEN {_sql_lit(R.FOLLOW_UP_HEADER)} || 'Previous Question: ' || "
            f"{_s('prev_question')} || {NL} || {NL} || 'Previous Answer:' || {NL} || prev_answer || {NL} || {NL} || "
            f"{_sql_lit(R.RULE + chr(10) + chr(10))} || CASE WHEN len(regexp_extract_all(prev_answer, "
            f"'\\d{{4}}-\\d{{2}}-\\d{{2}}')) > 0 THEN '  IMPORTANT: The previous answer mentioned dates: ' || {dates} "
            f"|| {NL} || {_sql_lit(R.DATE_HINT_TAIL)} ELSE '' END ELSE '' END")
    return (f"SELECT q.conv_id, q.q_idx, {prev} || coalesce(r.record, '') || "
            f"{_sql_lit(chr(10) + R.RULE + chr(10) + 'CURRENT QUESTION: ')} || {_s('q.question')} || "
            f"{_sql_lit(chr(10) + R.RULE + chr(10) + chr(10))} || CASE WHEN prev_answer IS NOT NULL THEN "
            f"{_sql_lit(R.FOLLOW_UP_INSTRUCTIONS)} ELSE '' END AS prompt "
            f"FROM prevq q LEFT JOIN recs r ON q.subject_id = r.subject_id")


_PREVQ_SQL = """SELECT *, conv_id AS subject_id,
  last_value(CASE WHEN answer IS NOT NULL THEN question END IGNORE NULLS) OVER w AS prev_question,
  last_value(CASE WHEN answer IS NOT NULL THEN answer END IGNORE NULLS) OVER w AS prev_answer
FROM ex WINDOW w AS (PARTITION BY conv_id ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register("build_prompt", with_ctes(_prompt_sql(), *_PART_TABLES,
                                    extra=_record_sql_ctes() + (("dated", _DATED_SQL), ("ex", _EXCHANGES_SQL),
                                                                  ("prevq", _PREVQ_SQL))))
def q_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per conversation question; the conversation id names the
    subject. Records are rendered only for the subjects asked about."""
    t = ClinicalTables(spark, sf_dir)
    conv = t.raw("conversations")
    qs = Q.previous_turn(Q.exchanges(_dated(conv))).withColumn("subject_id", F.col("conv_id"))
    # the subjects asked about, straight from the scan (not through the turn pairing)
    subjects = conv.select(F.col("conv_id").alias("subject_id")).distinct()
    recs = R.render_records(parts_for(t, subjects), t.tasks)
    return R.build_prompts(qs, recs).select("conv_id", "q_idx", "prompt")
