"""What stands around a mention: abbreviations, chunks, assertion status, snippets, capped occurrences.

These work on offsets and run in Arrow batches; each has a plain function for one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.cumulative import running_total

_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_ABBREVIATION = re.compile(r"\((?=[^()]*[^\W\d_])([^\W_][^\s()]{1,9})\)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])|\n+")
TARGET, MOST = 70, 95

# What denies, doubts or dates a mention, by status, and what ends its reach.
CUES = {
    "negated": ["no", "not", "without", "denies", "denied", "negative", "never", "none"],
    "uncertain": ["possible", "possibly", "probable", "suspected", "maybe", "might", "may", "could"],
    "historical": ["history", "previous", "previously", "prior", "past", "former", "old"],
    "family": ["mother", "father", "brother", "sister", "family", "aunt", "uncle", "hermano", "daughter"],
    "planned": ["planned", "scheduled", "plan", "await", "awaiting"],
    "confirmed": ["confirmed", "diagnosed", "proven", "positive"],
}
SCOPE_END = {"but", "however", "although", "except", "and", "or", "still"}
REACH = 6


def _long_form(short: str, before: str) -> str | None:
    """The shortest end of ``before`` that holds the signs of ``short`` in order, the first one at the start of a word
    (Schwartz and Hearst, 2003)."""
    at = len(before)
    for place in range(len(short) - 1, -1, -1):
        sign = short[place].lower()
        if not sign.isalnum():
            continue
        at -= 1
        while at >= 0 and (before[at].lower() != sign or place == 0 and at > 0 and before[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
    return before[before.rfind(" ", 0, at + 1) + 1 :]


def abbreviations(text: str) -> dict[str, str]:
    """Short forms in brackets with the words before them that they stand for. A short form has two to ten signs, a
    letter among them; its long form has at most twice as many words, or five more, and is longer than it."""
    out: dict[str, str] = {}
    for m in _ABBREVIATION.finditer(text):
        words = text[max(0, m.start() - 400) : m.start()].split()
        found = _long_form(m[1], " ".join(words[-min(len(m[1]) + 5, 2 * len(m[1])) :]))
        if found and len(found) > len(m[1]) and m[1] not in found.split():
            out.setdefault(m[1], found)
    return out


def chunk(text: str) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of chunks of whole sentences: closed from 70 tokens on, never over 95 unless one sentence
    alone is longer."""
    edges = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    out, start, size = [], 0, 0
    for a, b in zip(edges, edges[1:], strict=False):
        n = sum(1 for _ in _TOKEN.finditer(text, a, b))
        if size and size + n > MOST:
            out.append((start, a, size))
            start, size = a, 0
        size += n
        if size >= TARGET:
            out.append((start, b, size))
            start, size = b, 0
    if size:
        out.append((start, len(text), size))
    return out


def assertion(text: str, start: int, end: int) -> str:
    """Status of the mention text[start:end] by the nearest cue in its sentence within reach, or 'current'."""
    a = max(text.rfind(c, 0, start) for c in ".!?\n;") + 1
    before = [m[0].lower() for m in _TOKEN.finditer(text, a, start)][::-1]
    for w in before[:REACH]:
        status = next((s for s, words in CUES.items() if w in words), None)
        if status:
            return status
        if w in SCOPE_END:
            break
    stop = next((i for i in range(end, len(text)) if text[i] in ".!?\n;"), len(text))
    after = " ".join(m[0].lower() for m in _TOKEN.finditer(text, end, stop))
    if re.match(r"(?:\w+ ){0,3}(?:was|were|is|has been) (?:ruled out|excluded|negative|absent)", after + " "):
        return "negated"
    return "confirmed" if re.match(r"(?:was|were|is) (?:confirmed|proven|diagnosed)", after) else "current"


def _map(df: DataFrame, keep: list[str], text: str, schema: str, rows) -> DataFrame:
    names = [*keep, *(p.split()[0] for p in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*own, *r) for *own, t in b.itertuples(index=False, name=None) for r in rows(t)], columns=names)

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.where(F.col(text).isNotNull()).select(*keep, text).mapInPandas(run, f"{types}, {schema}")


def find_abbreviations(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return _map(df, keep, text, "short string, long string", lambda t: abbreviations(t).items())


def plan_chunks(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return _map(df, keep, text, "chunk int, start_pos int, end_pos int, n_tokens int", lambda t: [(i, *c) for i, c in enumerate(chunk(t), 1)])


def assert_mentions(df: DataFrame, keep: list[str], text: str, names: list[str]) -> DataFrame:
    """Status of every mention of the given names, case aside."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", re.I)
    return _map(df, keep, text, "name string, start_pos int, status string", lambda t: [(m[0].lower(), m.start(), assertion(t, m.start(), m.end())) for m in pattern.finditer(t)])


def snippet(text: Column, word: Column, width: int) -> Column:
    """``width`` characters on either side of the first occurrence of a word, case aside; null if it does not occur."""
    at = F.instr(F.lower(text), F.lower(word))
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.length(word) + width + F.least(at - 1, F.lit(width))))


def spread(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spread over its rows in order, the first and last among them. Places come
    from running counts over ranges, so no key has to fit one task."""
    placed = running_total(df, [*keys, *order], F.lit(1), "__at")
    bounds = placed.groupBy(*keys).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    same = reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    joined = placed.alias("a").join(bounds.alias("b"), same).select("a.*", "__from", "__n").withColumn("__i", (F.col("__at") - F.col("__from")).cast("int"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("__n") - 1) / (most - 1)).cast("int"))
    return joined.where((F.col("__n") <= most) | F.array_contains(picks, F.col("__i"))).drop("__n", "__i", "__at", "__from")
