"""The label dictionary: string search, visibility, preferred rows, lookups and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T

MODES = ["exact", "words", "normalizedWords", "normalizedString", "leftTruncation", "rightTruncation"]
# Order of preference of term types; others come after them.
TERM_TYPES = ["PT", "MH", "PN", "FN", "SY", "LN", "SCD", "IN", "AB"]


def visible(suppress: Column, obsolete: bool = False, suppressible: bool = False) -> Column:
    """N always; O too with ``obsolete``; E and Y too with ``suppressible``."""
    return suppress.isin(["N"] + ["O"] * obsolete + ["E", "Y"] * suppressible)


def search_labels(labels: DataFrame, text: str, mode: str, partial: bool = False) -> DataFrame:
    """Rows of ``labels`` (label, ...) that ``text`` finds. exact: the same string, case aside; words: all words of the
    text (with ``partial`` any); normalizedWords: the same by stems; normalizedString: the same key; leftTruncation
    and rightTruncation: the label ends or begins with the text. Null labels are never found."""
    label, low = F.col("label"), text.lower().strip()
    toks = T.tokens(label)
    want = T.tokens(F.lit(text))
    if mode in ("words", "normalizedWords"):
        if mode == "normalizedWords":
            toks, want = F.transform(toks, T.stem), F.transform(want, T.stem)
        found = F.arrays_overlap(toks, want) if partial else F.size(F.array_except(want, toks)) == 0
    else:
        found = {
            "exact": F.lower(F.trim(label)) == low,
            "normalizedString": T.normalized_key(label) == T.normalized_key(F.lit(text)),
            "leftTruncation": F.lower(F.trim(label)).endswith(low),
            "rightTruncation": F.lower(F.trim(label)).startswith(low),
        }[mode]
    return labels.where(found & label.isNotNull())


def preference() -> list[Column]:
    """Order in which rows of one concept are preferred."""
    place = F.array_position(F.array(*map(F.lit, TERM_TYPES)), F.col("tty"))
    return [F.when(F.col("suppress") == "N", 0).otherwise(1), F.when(F.col("ispref") == "Y", 0).otherwise(1), F.when(F.coalesce(place, F.lit(0)) == 0, 99).otherwise(place), F.length("label"), F.col("label"), F.col("row_id")]


def best_rows(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The preferred row of each key; an aggregate with partial sums, so a key of any size is no burden."""
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(preference())))
    return labels.where("label is not null").groupBy(*keys).agg(F.min_by(F.struct("row_id", "label"), order).alias("best")).select(*keys, "best.row_id", "best.label")


def labels_per_concept(labels: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` labels of each concept in order of preference, spellings that differ in case only once."""
    first = labels.where("label is not null").withColumn("low", F.lower("label"))
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(preference())))
    first = first.groupBy("cui", "low").agg(F.min(order).alias("o"), F.min_by("label", order).alias("label"))
    place = F.row_number().over(Window.partitionBy("cui").orderBy("o"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("cui", "place", "label")
