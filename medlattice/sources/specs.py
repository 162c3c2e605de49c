"""Table specifications as data.

One generic ingest function is driven by these specs instead of one
hand-written loader per table. Column syntax: ``name:kind[(maxlen)][?]``;
``?`` marks a nullable column, ``(n)`` a VARCHAR length limit. Kinds:
``int long short dbl ts date str``. Codes (icd_code, ndc, gsn, drg_code) are
read as strings so leading zeros survive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FIRST_WINS = "first_wins"   # INSERT … ON CONFLICT DO NOTHING
APPEND = "append"           # plain INSERT (surrogate key)


@dataclass(frozen=True)
class Col:
    name: str
    kind: str
    nullable: bool = True
    max_len: int | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    module: str                       # 'hosp' or 'icu'
    columns: tuple[Col, ...]
    key: tuple[str, ...] = ()         # PK or UNIQUE key (first wins)
    policy: str = APPEND
    optional: bool = True             # missing file -> empty table (S7)
    checks: tuple[tuple[str, str], ...] = ()          # (name, SQL predicate), NULL passes (N7)
    fks: tuple[tuple[str, str, str], ...] = ()        # (column, parent table, parent column)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # S6 fallbacks by presence
    renames: dict[str, str] = field(default_factory=dict)              # CSV name -> table name
    defaults_if_absent: dict[str, object] = field(default_factory=dict)  # S5
    label_default: str | None = None  # S4: column defaulted to 'Lab Item {itemid}'

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def col(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


_COL_RE = re.compile(r"^(\w+):(\w+)(?:\((\d+)\))?(\?)?$")


def cols(text: str) -> tuple[Col, ...]:
    out = []
    for tok in text.split():
        m = _COL_RE.match(tok)
        if not m:
            raise ValueError(f"bad column spec {tok!r}")
        name, kind, n, opt = m.groups()
        out.append(Col(name, kind, nullable=bool(opt), max_len=int(n) if n else None))
    return tuple(out)


SUBJ = ("subject_id", "patients", "subject_id")
HADM = ("hadm_id", "admissions", "hadm_id")
STAY = ("stay_id", "icustays", "stay_id")
ITEM = ("itemid", "d_items", "itemid")
ICD_VERSION_CHECK = ("icd_version_in_9_10", "icd_version IN (9, 10)")

SPECS: dict[str, TableSpec] = {s.name: s for s in [
    TableSpec("patients", "hosp", cols(
        "subject_id:int gender:str(1)? anchor_age:int? anchor_year:int? anchor_year_group:str(20)? dod:date?"),
        key=("subject_id",), policy=FIRST_WINS, optional=False,
        checks=(("gender_m_f", "gender IN ('M', 'F')"),
                ("anchor_age_0_91", "anchor_age >= 0 AND anchor_age <= 91"),
                ("anchor_year_2100_2300", "anchor_year >= 2100 AND anchor_year <= 2300"))),
    TableSpec("admissions", "hosp", cols(
        "hadm_id:int subject_id:int admittime:ts dischtime:ts? deathtime:ts? admission_type:str(50)? "
        "admit_provider_id:str(50)? admission_location:str(100)? discharge_location:str(100)? "
        "insurance:str(50)? language:str(50)? marital_status:str(50)? race:str(100)? edregtime:ts? "
        "edouttime:ts? hospital_expire_flag:short?"),
        key=("hadm_id",), policy=FIRST_WINS, optional=False,
        checks=(("hospital_expire_flag_0_1", "hospital_expire_flag IN (0, 1)"),
                ("dischtime_after_admittime", "dischtime IS NULL OR dischtime >= admittime")),
        fks=(SUBJ,), aliases={"race": ("race", "ethnicity")}),
    TableSpec("transfers", "hosp", cols(
        "subject_id:int hadm_id:int? transfer_id_orig:int? eventtype:str(50)? careunit:str(50)? "
        "intime:ts? outtime:ts?"),
        fks=(SUBJ, HADM), renames={"transfer_id": "transfer_id_orig"}),
    TableSpec("d_labitems", "hosp", cols(
        "itemid:int label:str(200) fluid:str(100)? category:str(100)? loinc_code:str(50)?"),
        key=("itemid",), policy=FIRST_WINS, label_default="label"),
    TableSpec("labevents", "hosp", cols(
        "subject_id:int hadm_id:int? specimen_id:int? itemid:int charttime:ts? storetime:ts? "
        "value:str(200)? valuenum:dbl? valueuom:str(50)? ref_range_lower:dbl? ref_range_upper:dbl? "
        "flag:str(10)? priority:str(10)? comments:str?"),
        fks=(SUBJ, HADM)),
    TableSpec("d_icd_diagnoses", "hosp", cols("icd_code:str(10) icd_version:int long_title:str?"),
              key=("icd_code", "icd_version"), policy=FIRST_WINS, checks=(ICD_VERSION_CHECK,),
              defaults_if_absent={"icd_version": 10}),
    TableSpec("diagnoses_icd", "hosp", cols(
        "subject_id:int hadm_id:int seq_num:int? icd_code:str(10) icd_version:int?"),
        key=("hadm_id", "seq_num"), policy=FIRST_WINS, checks=(ICD_VERSION_CHECK,),
        fks=(SUBJ, HADM), defaults_if_absent={"icd_version": 10}),
    TableSpec("d_icd_procedures", "hosp", cols("icd_code:str(10) icd_version:int long_title:str?"),
              key=("icd_code", "icd_version"), policy=FIRST_WINS, checks=(ICD_VERSION_CHECK,),
              defaults_if_absent={"icd_version": 10}),
    TableSpec("procedures_icd", "hosp", cols(
        "subject_id:int hadm_id:int seq_num:int? chartdate:date? icd_code:str(10) icd_version:int?"),
        checks=(ICD_VERSION_CHECK,), fks=(SUBJ, HADM), defaults_if_absent={"icd_version": 10}),
    TableSpec("prescriptions", "hosp", cols(
        "subject_id:int hadm_id:int? pharmacy_id:int? poe_id:str? poe_seq:int? starttime:ts? stoptime:ts? "
        "drug_type:str? drug:str? gsn:str? ndc:str? prod_strength:str? form_rx:str? dose_val_rx:str? "
        "dose_unit_rx:str? form_val_disp:str? form_unit_disp:str(50)? doses_per_24_hrs:dbl? route:str(50)?"),
        fks=(SUBJ, HADM)),
    TableSpec("emar", "hosp", cols(
        "subject_id:int hadm_id:int? emar_id:str(50) emar_seq:int? poe_id:str(50)? pharmacy_id:int? "
        "charttime:ts? medication:str? event_txt:str(100)? scheduletime:ts? storetime:ts?"),
        key=("emar_id",), policy=FIRST_WINS, fks=(SUBJ, HADM)),
    TableSpec("poe", "hosp", cols(
        "poe_id:str(50) poe_seq:int? subject_id:int hadm_id:int? ordertime:ts? order_type:str(50)? "
        "order_subtype:str(100)? transaction_type:str(50)? discontinue_of_poe_id:str(50)? "
        "discontinued_by_poe_id:str(50)? order_provider_id:str(50)? order_status:str(50)?"),
        key=("poe_id",), policy=FIRST_WINS, fks=(SUBJ, HADM)),
    TableSpec("drgcodes", "hosp", cols(
        "subject_id:int hadm_id:int drg_type:str(50)? drg_code:str(10)? description:str? "
        "drg_severity:short? drg_mortality:short?"),
        fks=(SUBJ, HADM)),
    TableSpec("d_items", "icu", cols(
        "itemid:int label:str(200)? abbreviation:str(100)? linksto:str(50)? category:str(100)? "
        "unitname:str(50)? param_type:str(50)? lownormalvalue:dbl? highnormalvalue:dbl?"),
        key=("itemid",), policy=FIRST_WINS),
    TableSpec("icustays", "icu", cols(
        "stay_id:int subject_id:int hadm_id:int? first_careunit:str(50)? last_careunit:str(50)? "
        "intime:ts? outtime:ts? los:dbl?"),
        key=("stay_id",), policy=FIRST_WINS, fks=(SUBJ, HADM)),
    TableSpec("chartevents", "icu", cols(
        "subject_id:int hadm_id:int? stay_id:int? caregiver_id:int? charttime:ts? storetime:ts? "
        "itemid:int value:str(200)? valuenum:dbl? valueuom:str(50)? warning:short?"),
        fks=(SUBJ, HADM, STAY, ITEM)),
    TableSpec("inputevents", "icu", cols(
        "subject_id:int hadm_id:int? stay_id:int? caregiver_id:int? starttime:ts? endtime:ts? storetime:ts? "
        "itemid:int amount:dbl? amountuom:str(50)? rate:dbl? rateuom:str(50)? orderid:int? linkorderid:int? "
        "ordercategoryname:str(100)? secondaryordercategoryname:str(100)? "
        "ordercomponenttypedescription:str(200)? ordercategorydescription:str(100)? patientweight:dbl? "
        "totalamount:dbl? totalamountuom:str(50)? isopenbag:short? continueinnextdept:short? "
        "statusdescription:str(50)? originalamount:dbl? originalrate:dbl?"),
        fks=(SUBJ, HADM, STAY, ITEM)),
]}

# Load order: parents before children (foreign keys), as the reference loads.
LOAD_ORDER = ["patients", "admissions", "transfers", "d_labitems", "labevents", "d_icd_diagnoses",
              "diagnoses_icd", "d_icd_procedures", "procedures_icd", "prescriptions", "emar", "poe",
              "drgcodes", "d_items", "icustays", "chartevents", "inputevents"]

# Tables the reference counts after a load (26; nine of them have no loader).
COUNTED_TABLES = ["patients", "admissions", "transfers", "diagnoses_icd", "d_icd_diagnoses",
                  "procedures_icd", "d_icd_procedures", "labevents", "d_labitems", "prescriptions", "emar",
                  "emar_detail", "poe", "microbiologyevents", "drgcodes", "services", "provider", "icustays",
                  "d_items", "caregiver", "chartevents", "datetimeevents", "inputevents", "ingredientevents",
                  "outputevents", "procedureevents"]
