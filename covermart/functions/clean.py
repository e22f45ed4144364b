"""Cleaning expressions for one raw column. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covermart.fixed_values import MISSING_TOKENS, UNASSIGNED

# Space characters (Unicode class Zs). Tabs and line breaks are kept.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_LONGEST_MISSING = max(map(len, MISSING_TOKENS))
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
_ISO_DATE = r"^([0-9]{4})[-/ ]([0-9]{1,2})[-/ ]([0-9]{1,2})"


def clean_text(raw: Column) -> Column:
    """Trimmed text, with every spelling of "missing" as NULL."""
    text = F.btrim(raw.cast("string"), F.lit(_SPACES))
    known = (F.length(text) > _LONGEST_MISSING) | ~F.lower(text).isin(*MISSING_TOKENS)
    return F.when(known, text)


def parse_number(raw: Column) -> Column:
    """Number without thousands commas, ``$``, ``USD`` or spaces; NULL when malformed."""
    digits = F.translate(clean_text(raw), ",$", "")
    digits = F.replace(F.replace(digits, F.lit("USD"), F.lit("")), F.lit(" "), F.lit(""))
    return F.regexp_extract(digits, _NUMBER, 0).try_cast("double")


def parse_integer(raw: Column) -> Column:
    """Number rounded half to even; NULL when malformed or out of range."""
    return F.rint(parse_number(raw)).try_cast("int")


def parse_date(raw: Column) -> Column:
    """Date from year-first text (any time part ignored), ``d m yyyy`` or ``d/m/yyyy``."""
    text = clean_text(raw)
    iso = F.regexp_replace(text, _ISO_DATE + rf"([ T]{_TIME}Z?)?$", "$1-$2-$3")
    return F.coalesce(
        F.when(text.rlike(_ISO_DATE + rf"([ T]{_TIME}Z?)?$"), iso.try_cast("date")),
        F.when(
            text.rlike(r"^[0-9]{1,2}([ /])[0-9]{1,2}\1[0-9]{4}$"),
            F.try_to_date(F.translate(text, "/", " "), "d M y"),
        ),
    )


def parse_timestamp(raw: Column) -> Column:
    """Zone-less timestamp from year-first text or fourteen digits ``yyyyMMddHHmmss``."""
    text = clean_text(raw)
    iso = F.regexp_replace(
        F.regexp_replace(text, r"Z$", ""), _ISO_DATE, "$1-$2-$3"
    )
    packed = F.regexp_replace(
        text,
        r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$",
        "$1-$2-$3 $4:$5:$6",
    )
    return F.coalesce(
        F.when(text.rlike(_ISO_DATE + rf"([ T]{_TIME}Z?)?$"), iso.try_cast("timestamp_ntz")),
        F.when(text.rlike(r"^[0-9]{14}$"), packed.try_cast("timestamp_ntz")),
    )


def unassigned(column: Column) -> Column:
    """Dimension label: NULL becomes ``Unassigned``."""
    return F.coalesce(column, F.lit(UNASSIGNED))
