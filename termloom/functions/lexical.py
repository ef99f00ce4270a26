"""Lexical features as column expressions: token places, variant keys, content words, expansions, denials, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS, let, stem, tokens

# Everyday words and the terms they stand for.
ALIASES = {"kidney": "renal", "heart": "cardiac", "liver": "hepatic", "lung": "pulmonary", "stomach": "gastric", "brain": "cerebral", "skin": "dermal"}
# Short forms, slips and what they are searched as; those with a second word only in its company.
EXPANSIONS = {r"\bbp\b": "blood pressure", r"\bmi\b.*\b(chest|heart)\b": "myocardial infarction", r"\bmri\b": "magnetic resonance imaging", r"\bct\b.*\bscan\b": "computed tomography", r"\bdiabetis\b": "diabetes", r"\bndc\b": "national drug code"}
# Words that deny what follows, and those that end their reach.
DENIALS = ["no", "not", "without", "denies", "denied", "never"]
BLOCKERS = ["but", "however", "although", "except"]
# Attributes by the words of a label.
ATTRIBUTES = {
    "severity": {"mild": r"\bmild\b", "severe": r"\bsevere\b"},
    "course": {"acute": r"\bacute\b", "chronic": r"\bchronic\b", "recurrent": r"\brecurrent\b"},
    "side": {"bilateral": r"\bbilateral\b", "left": r"\bleft\b", "right": r"\bright\b"},
    "form": {"tablet": r"\btablet", "injection": r"\binject"},
}
# Kinds of concept by the last word of a phrase.
WORD_KINDS = {"disorder": ["disease", "syndrome", "anomaly", "palsy", "ulcer", "gout", "lymphoma", "tremor"], "finding": ["symptoms", "sign", "level", "high", "normal", "phenomenon"], "event": ["recall", "treatment", "dosage", "test"]}
# Order of trust in sources of definitions.
TRUSTED = ["pubmed", "guideline", "query_log"]
#: What marks a row as personal.
PERSONAL = r"@|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"


def token_spans(text: Column) -> Column:
    """Runs of letters and digits with their places: array of struct(token, start, end), end exclusive."""
    parts = F.struct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0).alias("t"), F.split(text, "[A-Za-z0-9]+", -1).alias("g"))
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))

    def spans(p: Column) -> Column:
        start = lambda i: length(F.slice(p["g"], F.lit(1), i + 1)) + length(F.slice(p["t"], F.lit(1), i))
        return F.transform(p["t"], lambda w, i: let(start(i), lambda a: F.struct(w.alias("token"), a.alias("start"), (a + F.length(w)).alias("end"))))

    return let(parts, spans)


def variant_keys(toks: Column, most: int = 3) -> Column:
    """Keys of the tokens with any of the first ``most`` words that have another stem in that form, each once; at most
    two to the power of ``most`` keys."""

    def of(p: Column) -> Column:
        places = F.slice(F.filter(F.transform(p["t"], lambda w, i: F.when(w != p["s"][i], i)), lambda i: i.isNotNull()), 1, most)
        bit = lambda at, i: F.coalesce(F.array_position(at, i), F.lit(0)).cast("int")
        one = lambda at, mask: F.array_join(F.transform(p["t"], lambda w, i: F.when((bit(at, i) > 0) & (F.floor(mask / F.pow(F.lit(2.0), bit(at, i) - 1)) % 2 == 1), p["s"][i]).otherwise(w)), " ")
        return let(places, lambda at: F.array_distinct(F.transform(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size(at)).cast("int") - 1), lambda mask: one(at, mask))))

    keys = let(F.struct(toks.alias("t"), F.transform(toks, stem).alias("s")), of)
    return F.when(F.size(toks) > 0, keys).otherwise(F.array().cast("array<string>"))


def _alias(w: Column) -> Column:
    out = w
    for name, term in ALIASES.items():
        out = F.when(w == name, term).otherwise(out)
    return out


def content_tokens(text: Column) -> Column:
    """Tokens without stop words, everyday words as their terms, stemmed."""
    return F.transform(F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS)), lambda t: _alias(stem(_alias(t))))


def specific_tokens(text: Column) -> Column:
    """Content tokens of five letters or more, or with a digit."""
    return F.filter(content_tokens(text), lambda t: (F.length(t) >= 5) | t.rlike("[0-9]"))


def expanded(text: Column) -> Column:
    """What the short forms and slips of a query stand for; null if it has none."""
    return F.nullif(F.concat_ws(" ", *(F.when(F.lower(text).rlike(p), e) for p, e in EXPANSIONS.items())), F.lit(""))


def sentence_with(text: Column, word: str) -> Column:
    """The first sentence that holds ``word``, case aside; null if none does."""
    return F.get(F.filter(F.split(text, r"[.!?]\s+"), lambda s: F.lower(s).contains(word)), F.lit(0))


def denied(docs: DataFrame, reach: int = 6) -> DataFrame:
    """(doc, token, penalty): words of docs (doc, text) that a denial reaches: 0.52 for the next two, 0.40 to the fourth,
    0.24 to the sixth; the highest counts. What ends its reach ends it, and each document stays in its row."""

    def at(t: Column, i: Column) -> Column:
        ahead = F.slice(t, i + 2, reach)
        free = F.aggregate(ahead, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("w")), lambda s, w: F.struct((s["on"] & ~w.isin(BLOCKERS)).alias("on"), F.when(s["on"] & ~w.isin(BLOCKERS), F.concat(s["w"], F.array(w))).otherwise(s["w"]).alias("w")))["w"]
        return F.transform(free, lambda w, n: F.struct(w.alias("token"), F.when(n < 2, 0.52).when(n < 4, 0.40).otherwise(0.24).alias("penalty")))

    found = lambda t: F.flatten(F.transform(F.filter(F.transform(t, lambda w, i: F.when(w.isin(DENIALS), i)), lambda i: i.isNotNull()), lambda i: at(t, i)))
    hits = docs.select("doc", F.explode(let(tokens(F.col("text")), found)).alias("x")).select("doc", "x.*")
    return hits.where(~F.col("token").isin(STOPWORDS) & ~F.col("token").isin(DENIALS)).groupBy("doc", "token").agg(F.max("penalty").alias("penalty"))


def attributes(label: Column) -> Column:
    """Array of struct(attribute, value) that the words of a label give away."""
    low = F.lower(label)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value"))) for a, ws in ATTRIBUTES.items() for v, p in ws.items())))


def kind_of_word(word: Column) -> Column:
    out = F.lit("other")
    for kind, words in reversed(WORD_KINDS.items()):
        out = F.when(word.isin(words), kind).otherwise(out)
    return out


def union_of(names: Column) -> Column:
    """The names in their order, spellings that differ in case only once."""
    return let(F.transform(names, F.lower), lambda low: F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))


def guarded(df: DataFrame, count: str, text: str, least: int) -> DataFrame:
    """``df`` with the ``verdict`` on each row: kept, no_count, too_few (below ``least`` people) or personal. Columns that
    name single persons are refused outright."""
    personal = {"person_id", "patient_id", "subject_id", "birth_date", "mrn"} & {c.lower() for c in df.columns}
    if personal:
        raise ValueError(f"columns of single persons: {sorted(personal)}")
    v = F.when(F.col(count).isNull(), "no_count").when(F.col(count) < least, "too_few").when(F.coalesce(F.col(text), F.lit("")).rlike(PERSONAL), "personal").otherwise("kept")
    return df.withColumn("verdict", v)
