"""Several values packed into one field: one row per value, with its position.

Quoted and bracketed spans are swapped for indexed placeholders, what is left is split at the delimiters, and
the spans are put back from an array by their index. Everything is built-in column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import let

#: Brackets within brackets are kept together to this depth.
DEPTH = 16
#: Spans inside which nothing separates: a double-quoted string (doubled quotes escape) or round brackets, nested ones
#: with all they hold.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BRACKETS = r'\([^()"]*+(?:' + QUOTED + r'[^()"]*+)*+\)'
for _ in range(DEPTH - 1):
    _BRACKETS = r'\([^()"]*+(?:(?:' + QUOTED + "|" + _BRACKETS + r')[^()"]*+)*+\)'
SPAN = QUOTED + "|" + _BRACKETS
#: Delimiters outside spans. Blanks are no delimiter; see BARE.
DELIMITERS = r"[;,|\t\r\n]"
#: A bare identifier, such as ``C0001234`` or ``SNO:1234``.
BARE = r"[A-Za-z]+[:_]?[0-9]+"

_OPEN, _CLOSE, _ESCAPE, _CUT = "\ue000", "\ue001", "\ue002", "\ue003"


def split_packed(field: Column, delimiters: str = DELIMITERS) -> Column:
    """Array of the values of a packed field, as written, without blanks around them, enclosing double quotes
    (doubled quotes inside become single) or square brackets around the whole list.

    Null gives null; a field without any value gives an empty array. The four private-use characters that serve
    as marks are escaped where the data itself contains them, so no placeholder can collide with the text. A
    quote or bracket that is never closed holds nothing together and is kept as written.
    """
    # marks in the data become ESCAPE + digit, so that OPEN, CLOSE and CUT are free to be used
    text = field
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "2"))
    for digit, mark in (("0", _OPEN), ("1", _CLOSE), ("3", _CUT)):
        text = F.replace(text, F.lit(mark), F.lit(_ESCAPE + digit))
    whole = r"^\s*\[([\s\S]*)\]\s*$"
    text = F.when(text.rlike(whole), F.regexp_extract(text, whole, 1)).otherwise(text)

    def split(t: Column) -> Column:
        return let(F.struct(F.regexp_extract_all(t, F.lit(SPAN), 0).alias("spans"), F.split(t, SPAN, -1).alias("between")), pieces)

    def pieces(x: Column) -> Column:
        last = F.size(x["between"]) - 1
        marked = F.array_join(F.transform(x["between"], lambda part, i: F.concat(part, F.when(i < last, F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))).otherwise(""))), "")
        cuts = F.regexp_replace(marked, delimiters, _CUT)
        cuts = F.regexp_replace(cuts, rf"(?<=^|[\s{_CUT}])({BARE})\s+(?={BARE}(?:\s|{_CUT}|$))", f"$1{_CUT}")
        return F.filter(F.transform(F.split(cuts, _CUT, -1), lambda piece: let(piece, lambda p: restore(p, x["spans"]))), lambda v: v != "")

    def restore(piece: Column, spans: Column) -> Column:
        parts = F.struct(F.split(piece, f"{_OPEN}[0-9]+{_CLOSE}", -1).alias("texts"), F.regexp_extract_all(piece, F.lit(f"{_OPEN}([0-9]+){_CLOSE}"), 1).alias("at"))
        joined = let(
            parts,
            lambda x: F.array_join(
                F.transform(x["texts"], lambda t, i: F.concat(t, F.when(i < F.size(x["at"]), F.get(spans, F.get(x["at"], i).cast("int"))).otherwise(""))), ""
            ),
        )
        return let(F.regexp_replace(joined, r"^\s+|\s+$", ""), plain)

    def plain(full: Column) -> Column:
        inside = F.replace(full.substr(F.lit(2), F.length(full) - 2), F.lit('""'), F.lit('"'))
        value = F.regexp_replace(F.when(full.rlike(f"^{QUOTED}$"), inside).otherwise(full), r"^\s+|\s+$", "")
        for digit, mark in (("0", _OPEN), ("1", _CLOSE), ("3", _CUT), ("2", _ESCAPE)):
            value = F.replace(value, F.lit(_ESCAPE + digit), F.lit(mark))
        return value

    return let(text, split)


def unpack(df: DataFrame, id_column: str, fields: list[str], delimiters: str = DELIMITERS) -> DataFrame:
    """One row ``(<id_column>, field, pos, val)`` per value of each packed field, ``pos`` counting from 1.

    Null fields and fields without any value give no row; repeated rows give their values each; other columns of
    ``df``, also ones named ``field``, ``pos`` or ``val``, play no part. An empty table gives no rows.
    """
    packed = F.array(*(F.struct(F.lit(f).alias("field"), split_packed(F.col(f"`{f}`")).alias("vals")) for f in fields))
    each = df.select(F.col(f"`{id_column}`").alias("__id"), F.explode(packed).alias("__f"))
    each = each.select("__id", F.col("__f.field").alias("field"), F.posexplode("__f.vals").alias("p", "val"))
    return each.select(F.col("__id").alias(id_column), "field", (F.col("p") + 1).cast("int").alias("pos"), "val")
