"""Cut oversized texts into pieces under a token limit, at natural boundaries, with overlap.

A text over the limit is halved at the strongest boundary near its middle, and the halves again, until every part
has at most the limit less the overlap; then each part is extended backward by the overlap. The parts together
are the text, character for character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 95
OVERLAP = 15
_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Boundaries between two tokens, strongest first: blank line, line break, sentence end, clause end, white space.
_STRENGTHS = [
    re.compile(r"\n\s*\n"),
    re.compile(r"\n"),
    re.compile("[.!?…。！？؟।][\"'”’»」』)\\]]*(?=\\s|$)|[。！？।][”’」』]?"),
    re.compile("[;:,、，；：](?=\\s|$)|[、，；：]"),
    re.compile(r"\s"),
]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of each piece of ``text``: the core parts tile the text, and ``start`` reaches back
    by up to ``overlap`` tokens. A text of at most ``limit`` tokens is one piece."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text))]
    if not 0 <= overlap < limit - 1:
        raise ValueError("the overlap must be at least two tokens below the limit")
    starts = np.array([a for a, _ in spans])
    n = len(spans)
    # gap g lies between tokens g-1 and g; its strength is that of the strongest boundary in it
    strength, place = np.zeros(n + 1, int), np.r_[0, starts[1:], len(text)]
    known: dict[str, tuple[int, int]] = {}
    for g in range(1, n):
        e = spans[g - 1][1]
        gap = text[e : spans[g][0]]
        found = known.get(gap)
        if found is None:
            found = known[gap] = _boundary(gap)
        if found[0]:
            strength[g], place[g] = found[0], e + found[1]
    most = limit - overlap
    stack, parts = [(0, n)], []
    while stack:
        a, b = stack.pop()
        if b - a <= (limit if a == 0 and b == n else most):
            parts.append((a, b))
            continue
        lo, hi, mid = a + max(1, (b - a) // 4), b - max(1, (b - a) // 4), (a + b) / 2
        gaps = np.arange(lo, hi + 1)
        g = int(gaps[np.lexsort((np.abs(gaps - mid), -strength[gaps]))[0]])
        stack += [(g, b), (a, g)]
    out = []
    for a, b in parts:
        core = 0 if a == 0 else int(place[a])
        back = core if a == 0 or overlap == 0 else int(starts[max(0, a - overlap)])
        out.append((back, core, len(text) if b == n else int(place[b])))
    return out


def _boundary(gap: str) -> tuple[int, int]:
    """(strength, place) of the strongest boundary in what stands between two tokens: the cut comes after it and the
    white space behind it."""
    for level, pattern in zip(range(len(_STRENGTHS), 0, -1), _STRENGTHS, strict=True):
        m = pattern.search(gap + "0")  # a token follows
        if m and m.end() <= len(gap):
            at = m.end()
            while at < len(gap) and gap[at].isspace():
                at += 1
            return level, at
    return 0, 0


def split_pieces(df: DataFrame, id_column: str, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each text: ``id_column``, the ``keep`` columns, ``piece`` (from 1), ``n_pieces``,
    ``start_pos``, ``core_pos``, ``end_pos`` (code points, end exclusive), ``n_tokens`` and ``piece_text``.

    Tokens are maximal runs of ASCII letters or digits. Null texts give no row; empty ones a single empty piece.
    Repeated rows give their pieces each. Columns of ``df`` that are not kept play no part.
    """
    fields = [df.schema[id_column], *(df.schema[k] for k in keep)]
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in ("piece", "n_pieces", "start_pos", "core_pos", "end_pos", "n_tokens")), T.StructField("piece_text", T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, t in batch.itertuples(index=False, name=None):
                found = cuts(t, limit, overlap)
                rows += [(*own, i, len(found), a, c, b, len(_TOKEN.findall(t[a:b])), t[a:b]) for i, (a, c, b) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=names)

    chosen = df.where(F.col(f"`{text}`").isNotNull()).select(id_column, *keep, F.col(f"`{text}`").alias("__text"))
    return chosen.mapInPandas(run, schema)
