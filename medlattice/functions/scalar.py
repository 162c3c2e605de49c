"""Column expressions for the reference's scalar semantics.

All of these build Catalyst expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default NA words pandas' read_csv turns into missing values.
PANDAS_NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- S3 / N6: NA normalisation and lenient casts ---------------------------

def na_normalize(c: str | Column) -> Column:
    """NA words and empty cells become NULL (S3). The whole cell must be the word:
    a padded word is text."""
    c = col_(c)
    return F.when(c.isin(*PANDAS_NA_WORDS), F.lit(None)).otherwise(c)


def lenient_cast(c: str | Column, kind: str) -> Column:
    """Coerce a string column; failures become NULL instead of raising.

    ``int`` goes through double first so '12.0' gives 12 and 3.7 truncates to 3.
    """
    c = na_normalize(c)
    if kind == "int":
        return _try_int(c, "int")
    if kind == "long":
        return _try_int(c, "long")
    if kind == "short":
        return _try_int(c, "short")
    if kind == "dbl":
        return c.try_cast("double")
    if kind == "ts":
        # ISO forms (date only, minutes, seconds, fractions, 'T') via the cast;
        # US month/day forms as a fallback.
        return F.coalesce(
            F.trim(c).try_cast("timestamp_ntz"),
            F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy H:mm")).cast("timestamp_ntz"),
            F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy")).cast("timestamp_ntz"),
        )
    if kind == "date":
        return F.to_date(lenient_cast(c, "ts"))
    if kind == "str":
        return c.cast("string")
    if kind == "bool":
        low = F.lower(F.trim(c))
        return (F.when(low.isin("true", "t", "1", "yes", "y"), F.lit(True))
                .when(low.isin("false", "f", "0", "no", "n"), F.lit(False)))
    raise ValueError(f"unknown kind {kind!r}")


def _try_int(c: Column, spark_type: str) -> Column:
    # Through double so '12.0' parses; the narrowing truncates toward zero and
    # gives NULL when out of range.
    return c.try_cast("double").try_cast(spark_type)


# --- N4: Python truthiness ---------------------------------------------------

def truthy_str(c: str | Column) -> Column:
    c = col_(c)
    return c.isNotNull() & (c != "")


def truthy_num(c: str | Column) -> Column:
    c = col_(c)
    return c.isNotNull() & (c != 0)


def py_str(c: str | Column) -> Column:
    """``str(x)`` as an f-string prints it: NULL renders as ``None`` (§2.2.1)."""
    return F.coalesce(col_(c).cast("string"), F.lit("None"))


# --- N5: fixed-decimal formatting -------------------------------------------

def fmt_1f(c: str | Column) -> Column:
    """``f"{x:.1f}"``: half-even, no grouping separators."""
    return F.regexp_replace(F.format_number(col_(c), 1), ",", "")


# --- F1 / F2: status labels -------------------------------------------------

def vital_status(dod: str | Column) -> Column:
    return F.when(col_(dod).isNotNull(), "Deceased").otherwise("Living")


def warning_status(warning: str | Column) -> Column:
    return F.when(col_(warning) == 1, "Warning").otherwise("Normal")


# --- wall-clock arithmetic on TIMESTAMP_NTZ ---------------------------------
# Casting TIMESTAMP_NTZ to TIMESTAMP reads the wall clock in the session time
# zone, so differences shift across daylight-saving changes and day
# boundaries move. These helpers never involve a time zone.

_US_PER_DAY = 86_400_000_000


def epoch_us(c: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to the wall-clock time (any session zone)."""
    c = col_(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    secs = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long")
    return days * _US_PER_DAY + secs * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def ntz_from_epoch_us(us: Column) -> Column:
    """Inverse of :func:`epoch_us`: a TIMESTAMP_NTZ."""
    day = F.floor(us / F.lit(_US_PER_DAY))
    rest = ((us - day * F.lit(_US_PER_DAY)) / F.lit(1_000_000)).cast("decimal(18,6)")
    base = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest)


def day_start(c: str | Column) -> Column:
    """DATE_TRUNC('day', ts) for TIMESTAMP_NTZ, kept as TIMESTAMP_NTZ."""
    return F.to_date(col_(c)).cast("timestamp_ntz")


def utc_instant(c: str | Column) -> Column:
    """The wall-clock time read as UTC, as a TIMESTAMP (for watermarks)."""
    return F.timestamp_micros(epoch_us(c))


def ntz_of_instant(c: str | Column) -> Column:
    """Back from :func:`utc_instant` to TIMESTAMP_NTZ."""
    return ntz_from_epoch_us(F.unix_micros(col_(c)))


# --- F3: length of stay -----------------------------------------------------

def los_days(start: str | Column, end: str | Column) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 86400 as a double (NULL if either is)."""
    return (epoch_us(end) - epoch_us(start)) / F.lit(86400e6)


# --- F8 / F9: truncation ----------------------------------------------------

def ellipsize(c: str | Column, n: int, always: bool = False) -> Column:
    """First n code points plus '...' when longer than n (or always, SQ variant)."""
    c = col_(c)
    if always:
        return F.concat(F.substring(c, 1, n), F.lit("..."))
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


# --- F10: dates mentioned in text -------------------------------------------

DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"


def extract_dates(c: str | Column) -> Column:
    """Distinct yyyy-mm-dd strings in the text, sorted (Python's set order is arbitrary)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col_(c), F.lit(DATE_PATTERN), 0)))


# --- F11: source name from URI ----------------------------------------------

def source_name(uri: str | Column, missing: str = "Unknown") -> Column:
    """Last path segment of a URI; NULL/empty URI gives ``missing``."""
    u = col_(uri)
    return F.when(u.isNull() | (u == ""), F.lit(missing)).otherwise(F.substring_index(u, "/", -1))
