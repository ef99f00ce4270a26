"""Identifiers: classification, codes of named systems, stable ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of the identifiers of the terminology release files.
IDENTIFIER_FORMS = {"CUI": r"^C\d{7}$", "AUI": r"^A\d{7,8}$", "LUI": r"^L\d{7,8}$", "SUI": r"^S\d{7,8}$", "RUI": r"^R\d{7,8}$", "ATUI": r"^AT\d+$", "TUI": r"^T\d{3}$"}
# Other names of source vocabularies.
SYSTEM_ALIASES = {"SNO": "SNOMEDCT_US", "SNOMED": "SNOMEDCT_US", "SNOMEDCT": "SNOMEDCT_US", "ICD10": "ICD10CM", "LOINC": "LNC", "MESH": "MSH", "HPO": "HPO"}
SYSTEM_CODE = r"^([A-Za-z][A-Za-z0-9_ -]{1,31}):(.+)$"


def identifier_type(value: Column) -> Column:
    """Type of an identifier by its form, case aside; empty if it has none of the forms."""
    v = F.upper(F.trim(value))
    out = F.lit("")
    for name, form in reversed(IDENTIFIER_FORMS.items()):
        out = F.when(v.rlike(form), name).otherwise(out)
    return F.coalesce(F.when(v.isNull(), "").otherwise(out), F.lit(""))


def system_name(value: Column) -> Column:
    """Name of a source vocabulary with its aliases resolved."""
    v = F.upper(F.trim(value))
    out = v
    for alias, name in SYSTEM_ALIASES.items():
        out = F.when(v == alias, name).otherwise(out)
    return out


def system_code(value: Column) -> Column:
    """struct(system, code) of ``SYSTEM:CODE``; null if the value has another form."""
    made = F.struct(system_name(F.regexp_extract(value, SYSTEM_CODE, 1)).alias("system"), F.trim(F.regexp_extract(value, SYSTEM_CODE, 2)).alias("code"))
    return F.when(F.trim(value).rlike(SYSTEM_CODE), made)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the SHA-1 of the parts, joined by tabs; null parts count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\t", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 20))


def release_order(value: Column) -> Column:
    """Sortable number of a release name such as 2024AB; 0 for anything else."""
    year, half = F.regexp_extract(value, r"^(\d{4})([A-Z]{2})$", 1), F.regexp_extract(value, r"^(\d{4})([A-Z]{2})$", 2)
    return F.when(half != "", year.cast("int") * 1000 + (F.ascii(half) - 65) * 26 + F.ascii(F.substring(half, 2, 1)) - 65).otherwise(0)
