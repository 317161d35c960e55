"""Names that Windows accepts, comparison keys, UTF-16 lengths and numeric suffixes.

All are built-in expressions except Unicode normalisation and case folding, which Spark lacks and Arrow UDFs do.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

#: Characters that a Windows name may not have, control characters apart. A fixed value.
INVALID = r'<>:"/\\|?*'
#: Names of devices, whatever follows a dot. A fixed value.
DEVICES = r"(?:CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|COM[1-9¹²³]|LPT[1-9¹²³])"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, then case folding: names with equal keys are one name to Windows."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def key_of(name: Column, ascii_only: bool = False) -> Column:
    """The comparison key; for names known to be ASCII, lower() is the same and stays in the JVM."""
    return F.lower(name) if ascii_only else folded(name)


def stripped(text: Column) -> Column:
    """Without Unicode white space on either side."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_component(name: Column, ascii_only: bool = False) -> Column:
    """``name`` as one component of a Windows path: bad characters become _, ends are trimmed, device names prefixed.

    One chain of replacements: an expression that named an earlier step twice would double with every step.
    """
    clean = F.regexp_replace(name if ascii_only else nfc(name), rf"[{INVALID}\x00-\x1F]|[\uD800-\uDFFF]", "_")
    clean = F.regexp_replace(stripped(clean), r"[ .]+\z", "")
    return F.regexp_replace(F.regexp_replace(clean, r"\A\z", "_"), rf"(?iu)\A(?={DEVICES} *(?:\.|\z))", "_")


def is_device(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, ".", 1), r"[ .]+$", "").rlike(rf"(?iu)^{DEVICES}$")


def utf16_units(text: Column) -> Column:
    """UTF-16 code units: two for characters beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def truncate_utf16(text: Column, units: Column) -> Column:
    """The longest beginning of at most so many units that splits no character."""
    step = lambda acc, c: F.when(acc["full"] | (acc["used"] + utf16_units(c) > units), F.struct(acc["text"].alias("text"), acc["used"].alias("used"), F.lit(True).alias("full"))).otherwise(
        F.struct(F.concat(acc["text"], c).alias("text"), (acc["used"] + utf16_units(c)).alias("used"), F.lit(False).alias("full"))
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))
    exact = F.aggregate(F.split(text, ""), start, step)["text"]
    return F.when(units <= 0, F.lit("")).when(utf16_units(text) <= units, text).when(utf16_units(text) == F.length(text), F.substring(text, F.lit(1), units.cast("int"))).otherwise(exact)


#: A name's stem and its suffix from the last dot; a name that starts with its only dot or ends with one has no suffix.
SUFFIXED = r"(?s)^(.+)(\.[^.]+)$"


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, SUFFIXED, 2)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def numbered(stem: Column, n: Column, suffix: Column) -> Column:
    """The stem itself for 1, else with (n) after it, before the suffix."""
    return F.when(n == 1, F.concat(stem, suffix)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), suffix))


def without_number(stem: Column) -> Column:
    """Without one `` (n)`` at the end."""
    return F.regexp_replace(stem, r"(?U) \(\d+\)$", "")


def base_of(stem: Column) -> Column:
    """Without any number of `` (n)`` at the end: names of unlike bases cannot collide, whatever numbers they get."""
    return F.regexp_replace(stem, r"(?: \(\d+\))+$", "")
