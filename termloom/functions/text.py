"""Text functions as column expressions: folding, keys, tokens, stems, label scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def once(value: Column) -> Column:
    """``value`` as a column that is computed once: filters on a column of ``select`` are moved below it and compute it
    again, each for itself, while those on a generated column stay above."""
    return F.explode_outer(F.array(value))


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """Characters of the Latin, punctuation and full-width blocks whose compatibility decomposition leaves one ASCII
    character, and those characters."""
    pairs = {}
    for low, high in ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2150), (0x3000, 0x3001), (0xFF00, 0xFF5F)):
        for code in range(low, high):
            flat = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
            if len(flat) == 1:
                pairs[chr(code)] = flat
    return "".join(pairs), "".join(pairs.values())


def ascii_fold(text: Column) -> Column:
    """Compatibility-decomposed text without what is not ASCII. Signs that decompose to several characters (such as
    ligatures) are dropped."""
    return F.regexp_replace(F.translate(text, *fold_pairs()), r"[^\x00-\x7F]", "")


def normalized_key(text: Column) -> Column:
    """The universal join key: folded, lower case, runs of anything else than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " "))


def clean_text(text: Column) -> Column:
    """White space collapsed, none before punctuation, no NUL."""
    collapsed = F.trim(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit(" ")), r"[ \t\r\n\f]+", " "))
    return F.regexp_replace(collapsed, r" ([,.;:!?])", "$1")


def tokens(text: Column) -> Column:
    """Tokens of the key; an empty text has none."""
    return F.filter(F.split(normalized_key(text), " "), lambda t: t != "")


def feature_tokens(text: Column) -> Column:
    """Tokens and the character 3- and 4-grams of the text without blanks."""

    def grams(flat: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(flat) - size + 1, F.lit(1)))
        return F.when(F.length(flat) >= size, F.transform(starts, lambda i: F.substring(flat, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return let(tokens(text), lambda t: let(F.array_join(t, ""), lambda flat: F.concat(t, grams(flat, 3), grams(flat, 4))))


def ngrams(toks: Column, most: int) -> Column:
    """All runs of 1 to ``most`` tokens as (start, length, text)."""

    def of(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(t) - i + 1)), lambda n: F.struct(i.alias("start"), n.alias("length"), F.array_join(F.slice(t, i, n), " ").alias("text")))
        return F.when(F.size(t) > 0, F.flatten(F.transform(starts, at))).otherwise(F.array().cast("array<struct<start:int,length:int,text:string>>"))

    return let(toks, of)


# Words that neither begin nor end a phrase.
STOPWORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "with"]
# Endings and words whose final s is no plural.
SINGULAR_ENDINGS, SINGULAR_WORDS = ["ss", "us", "is"], ["diabetes", "herpes", "rabies", "always", "series"]


def stem(token: Column) -> Column:
    """A light stem: -ies to -y, -ves to -f, -ing and -ed off with a doubled letter undone, plural -s off."""

    def undouble(s: Column) -> Column:
        return F.when((F.length(s) >= 2) & (F.substring(s, -1, 1) == F.substring(s, -2, 1)), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)

    cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    n = F.length(token)
    kept = token.isin(SINGULAR_WORDS)
    for e in SINGULAR_ENDINGS:
        kept = kept | token.endswith(e)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(cut(token, 3), F.lit("y")))
        .when(token.endswith("ves") & (n > 5), F.concat(cut(token, 3), F.lit("f")))
        .when(token.endswith("ing") & (n > 6), undouble(cut(token, 3)))
        .when(token.endswith("ed") & (n > 5), undouble(cut(token, 2)))
        .when(token.endswith("s") & (n > 4) & ~kept, cut(token, 1))
        .otherwise(token)
    )


def display_label(label: Column) -> Column:
    """``A; B`` as ``B A`` when there are exactly two parts."""
    parts = F.filter(F.transform(F.split(label, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return let(parts, lambda p: F.when(label.contains(";") & (F.size(p) == 2), F.concat_ws(" ", p[1], p[0])).otherwise(label))


# Patterns of what should not be in an exported query.
PRIVACY_PATTERNS = {
    "email_like": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_like": r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})",
    "url_like": r"(?i)\b(?:https?://|www\.)\S+",
    "long_digit_run": r"\d{6,}",
    "non_ascii": r"[^\x00-\x7F]",
}


def privacy_flags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in PRIVACY_PATTERNS.items())))


def label_relevance(query: Column, label: Column) -> Column:
    """How well a label (distinct tokens, in order) answers a query (tokens): by the share it covers, more if its
    tokens stand in the query in order, and more if side by side."""
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))

    def score(lab: Column) -> Column:
        hit = F.filter(lab, lambda t: F.array_contains(query, t))
        whole = F.least(F.size(lab), F.lit(5)) * 0.10 + 0.60
        # in order: fold over the query, taking the next wanted token whenever it comes
        taken = F.aggregate(query, F.lit(0), lambda i, q: F.when(F.get(lab, i) == q, i + 1).otherwise(i))
        whole = whole + F.when(taken == F.size(lab), 0.08).otherwise(0.0) + F.when(joined(query).contains(joined(lab)), 0.05).otherwise(0.0)
        part = F.lit(0.25) + 0.35 * F.size(hit) / F.size(lab) + 0.03 * F.least(F.size(hit), F.lit(4))
        return F.when((F.size(lab) == 0) | (F.size(hit) == 0), 0.0).when(F.size(hit) == F.size(lab), whole).otherwise(part)

    return let(F.array_distinct(label), score)


def html_to_text(html: Column) -> Column:
    """Title (first h1, else title) and text of a page: struct(title, text). Script, style and the like go, common
    entities are resolved before tags are stripped, white space is collapsed."""
    s = html
    for tag in ("script", "style", "noscript", "svg", "canvas"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    title = F.regexp_extract(s, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.when(title != "", title).otherwise(F.regexp_extract(s, r"(?is)<title[^>]*>(.*?)</title>", 1))

    def plain(c: Column) -> Column:
        # fixed values: the entities that occur in running text
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        return clean_text(F.regexp_replace(c, r"(?s)<[^>]+>", " "))

    return F.struct(plain(title).alias("title"), plain(s).alias("text"))
