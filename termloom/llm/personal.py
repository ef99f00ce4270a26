"""Personal items in free text, found by bootstrapped contextual extraction and replaced by typed placeholders.

Every place that may hold an item is a candidate. Seed entities (numbers in an unmistakable national or international
format, common given names in a place fit for one, whole e-mail and street addresses) induce the lexical patterns they
stand in; the graph of patterns and instances is scored in rounds with Spark, and confident patterns and instances
discover the rest. Where the corpus has no pattern for a place, the score backs off to its prior: its form, its position
and the kinds of words around it (``personal_forms``). Where it has, frequent patterns outweigh the prior, so neither a
list of words nor a form decides alone. All scores are means over all occurrences in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import personal_forms as P
from termloom.session import cut

KINDS = ["person_name", "email", "phone", "id_number", "address"]
ROUNDS = 6
ACCEPT, ACCEPT_NAME = 0.5, 0.4
#: From this score on, a unit counts as known; weight of doubt against a pattern with few units.
SURE, DOUBT = 0.5, 0.2
#: Priors from which a place counts as a seed, and up to which it is taken for none and left out of the graph.
SEED_PRIOR, NO_PRIOR = 0.95, 0.03
#: Least prior of a seed name that the place must leave it, and of a small word among capitalised ones to be a candidate.
FIT_PRIOR, SMALL_PRIOR = 0.3, 0.3
#: Weight of the prior against the logarithm of the occurrences that a place's patterns were learned from.
BACK_OFF = 2.5
#: Most that the word next to a place adds to that weight, and the prior up to which it is not enough for a number.
CLOSE, UNLIKELY = 1.5, 0.05
#: Prior up to which a capitalised word needs patterns of its own place; that the word is a name elsewhere is not enough.
DOUBTFUL = 0.2
#: Words that stand alone at the start of a sentence in this share of at least so many places are common ones.
OPENS_SHARE, OPENS_LEAST = 0.5, 4
#: By kind: share of the instance in a unit's score, discount of unknown units, weight of the right side, of the
#: instance at an edge, and of long patterns that stay silent.
SETTINGS = {"phone": (0.1, 0.15, 0.4, 1.0, 0.0), "id_number": (0.1, 0.1, 1.0, 1.0, 0.0), "person_name": (0.5, 0.1, 0.9, 0.9, 0.1), "address": (0.1, 0.1, 0.5, 0.5, 0.0), "email": (0.1, 0.1, 0.5, 0.5, 0.0)}

_DIGIT, _AT_HINT = re.compile(r"\d"), re.compile(r"@|\bat\b", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*#?|[#№]|[.!?\n;]+")
_MONTH = re.compile(r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b")
_NEW = re.compile(r"\s+(?:[^\W\d_a-z][^\W\d_A-Z]|[IA]\b)")
_UNCASED = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_ELIDED = re.compile(r"(?:j|d|l|qu|n|s|c)['’]")
_NOUNS = {"der", "die", "und", "ich", "nicht", "das", "ist", "mein", "meine", "mit", "für", "den", "ein", "eine", "wurde", "hat", "mir", "gegen", "wir", "seit", "habe", "auch", "bei", "von", "dem", "zum", "zur", "am"}


def flat(text: str) -> str:
    """The text with compatibility forms (full-width digits and the like) replaced, character by character."""
    if text.isascii():
        return text
    return "".join(c if c.isascii() or len(n := unicodedata.normalize("NFKC", c)) != 1 else n for c in text)


def _apart(run: str) -> list[str]:
    """Numbers that stand side by side, with the blanks between them: a long group of digits or a whole telephone
    number behind at least five other digits is a number of its own."""
    parts = re.split(r"(\s+)(?=\d{9,})", run)
    m = re.fullmatch(r"(.*\d)(\s+)(\+\d.*|\(?\d{3}\)?[-. ]{0,2}\d{3}[-. ]{1,2}\d{4}|\d{3}-\d{4}|0\d{2,4} {1,2}\d{3,4} {1,2}\d{4}|0\d(?: {1,2}\d\d){4})", parts[-1])
    return [*parts[:-1], *m.groups()] if m and P.digits(m[1]) >= 5 else parts


def _spans(t: str) -> tuple[list[tuple[int, int, str, str]], str]:
    """(start, end, class, kind) of addresses, e-mail addresses and numbers, and the text with the former blotted out."""
    out: list[tuple[int, int, str, str]] = []
    shown = t
    numeric = _DIGIT.search(t) is not None  # addresses and numbers hold digits
    for kind, pattern, may in (("email", P.EMAIL, _AT_HINT.search(t)), ("address", P.ADDRESS, numeric), ("loose", P.LOOSE_ADDRESS, numeric)):
        found = [m.span() for m in pattern.finditer(shown)] if may else []
        for a, b in found:
            if kind == "loose" and _MONTH.search(shown, a, b):
                continue
            out.append((a, b, "item", kind))
            shown = f"{shown[:a]}{'■' * (b - a)}{shown[b:]}"
    taken: list[tuple[int, int]] = []
    for m in P.NUMBER.finditer(shown) if numeric else ():
        a = m.start()
        for part in _apart(m[0]):
            if P.digits(part) >= 5:
                taken.append((a, a + len(part)))
            a += len(part)
    for m in P.MIXED.finditer(shown) if numeric else ():
        if not any(a < m.end() and m.start() < b for a, b in taken):
            taken.append(m.span())
    out += [(a, b, "number", "") for a, b in taken]
    return sorted(out), shown


def _tokens(t: str, parts: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int, str]]:
    """(text, start, end, class) of the words, digits, ends of sentences and spans of a text."""
    tokens: list[tuple[str, int, int, str]] = []
    at = 0
    for a, b, c, _ in [*parts, (len(t), len(t), "", "")]:
        for m in _TOKEN.finditer(t, at, a):
            w = m[0]
            if w[0] in ".!?\n;":
                last = tokens[-1] if tokens else None
                # a point after a title, an initial or a short word that more than a new sentence may follow does not end the sentence
                if not (w == "." and last and last[3] == "word" and last[2] == m.start() and (last[0].lower() in P.TITLES or len(last[0]) <= 4 and (len(last[0]) < 2 or last[0][0].isupper() or not _NEW.match(t, m.end())))):
                    tokens.append(("<b>", m.start(), m.end(), "end"))
            else:
                tokens.append((w, m.start(), m.end(), "word" if any(map(str.isalpha, w)) or w in "#№" else "digits"))
        if c:
            tokens.append((t[a:b] if c == "number" else "<item>", a, b, c))
        at = b
    return tokens


def extract(text: str) -> Iterator[tuple]:
    """(kind, start, end, instance, left, left2, right, prior, second prior) of everything that may be a personal
    item. The second prior is that of an identity number, or, of a capitalised word, 1 alone at
    the start of a sentence and 0.5 in another doubtful place. ``lower`` gives words written small in a text that uses capitals."""
    t = flat(text)
    parts, _ = _spans(t)
    loose = {(a, b): k for a, b, _, k in parts if k}
    tokens = _tokens(t, parts)
    lows = [w.casefold() if c == "word" else "<n>" if c in ("digits", "number") else w for w, _, _, c in tokens]
    words = [w for w, _, _, c in tokens if c == "word"]
    telling = any(len(w) > 1 and w[0].isupper() and w[1:].islower() for w in words)
    small = sum(w[0].islower() for w in words)
    cased = telling and (len(words) < 5 or 3 * small >= len(words))
    nouns = cased and sum(w in _NOUNS for w in lows) >= 2

    def near(i: int, step: int, skip_initials: bool) -> tuple[str, int]:
        i += step
        while 0 <= i < len(tokens):
            if skip_initials and tokens[i][3] == "word" and (len(tokens[i][0]) == 1 or lows[i] in P.PARTICLES):
                i += step
                continue
            return lows[i], i
        return "<b>", i

    def opens(i: int) -> bool:
        """Whether token ``i`` is a function word with a capital: a new sentence, with or without a mark before it."""
        return cased and i < len(tokens) and tokens[i][0][0].isupper() and lows[i] in P.NEVER

    def around(i: int, step: int, n: int) -> list[str]:
        got = []
        while len(got) < n and 0 <= i < len(tokens) and not (step > 0 and opens(i)):
            got.append(lows[i])
            i += step
        return [*got, "<b>"]

    def joined(i: int) -> bool:
        """Whether only blanks, or the point of an initial, part token ``i`` from the next."""
        gap = t[tokens[i][2] : tokens[i + 1][1]]
        return not gap.strip() or gap.strip() == "." and len(tokens[i][0]) <= 2

    def partial(i: int) -> bool:
        return tokens[i][3] == "word" and lows[i] not in P.NEVER and lows[i] not in P.TITLES and tokens[i][0][0].isalpha()

    def name(i: int, w: str, low: str) -> tuple[float, float]:
        like = str.islower if w[0].islower() or not cased else str.isupper
        a = b = i
        reach = 2 if like is str.islower else 6
        while a > 0 and i - a < reach and joined(a - 1) and partial(a - 1) and (like(tokens[a - 1][0][0]) or lows[a - 1] in P.PARTICLES or not cased):
            if lows[a - 1] in P.PARTICLES and (a < 2 or not partial(a - 2) or not like(tokens[a - 2][0][0])):
                break
            if like is str.islower and (lows[a - 1] in P.KIN or lows[a - 1] in P.ASKING or lows[a - 1] in P.NAMING):
                break
            a -= 1
        while like is str.isupper and b + 1 < len(tokens) and b - i < reach and joined(b) and partial(b + 1) and (like(tokens[b + 1][0][0]) or lows[b + 1] in P.PARTICLES):
            b += 1
        while b > i and lows[b] in P.PARTICLES:
            b -= 1
        run = [re.sub(r"['’]s$", "", tokens[k][0]) for k in range(a, b + 1)]
        left = around(a - 1, -1, 3)
        if left[0] == "<b>" and a and "\n" not in t[tokens[a - 1][1] : tokens[a - 1][2]]:
            left = ["<b>"]  # a name may stand on the line below a greeting, not in the sentence behind it
        owner = lows[i + 1] if low != lows[i] and i + 1 < len(tokens) else ""
        start = left[0] in ("<b>", "<item>")
        prior = P.name_prior(w, run, i - a, left, around(b + 1, 1, 3), start, cased, nouns, owner)
        return prior, (1.0 if start and a == b else 0.5 if prior <= DOUBTFUL else 0.0) if cased and w[0].isupper() else 0.0

    for i, (w, a, b, c) in enumerate(tokens):
        if c in ("item", "number"):
            if c == "number" and P.DATE.fullmatch(w):
                continue
            l1, j = near(i, -1, False)
            l2 = near(j, -1, False)[0] if l1 != "<b>" else "<b>"
            r1, j = near(i, 1, False)
            r2 = near(j, 1, False)[0] if r1 != "<b>" else "<b>"
            before, after = around(i - 1, -1, 6), around(i + 1, 1, 3)
            if c == "number":
                yield "number", a, b, P.seed_kind(w) + "/" + P.shape(w), l1, f"{l2} {l1}", f"{r1} {r2}", *P.number_priors(w, before, after)
            elif loose[a, b] == "email":
                yield "email", a, b, "email", l1, f"{l2} {l1}", f"{r1} {r2}", P.email_prior(t[a:b]), 0.0
            else:
                strict = loose[a, b] == "address"
                yield "address", a, b, "strict" if strict else "loose", l1, f"{l2} {l1}", f"{r1} {r2}", P.address_prior(t[a:b], strict, before), 0.0
        elif c == "word" and len(w) > 1 and w[0].isalpha() and not _DIGIT.search(w):
            low = lows[i]
            if low in P.NEVER or low in P.TITLES or low in P.PARTICLES or not w.isascii() and _UNCASED.search(w) or _ELIDED.match(low):
                continue
            if low.endswith(("'s", "’s")):
                low, w, b = low[:-2], w[:-2], b - 2
                if len(low) < 2 or low in P.TITLES or low in P.NEVER:
                    continue
            prior, first = name(i, w, low)
            if telling and w[0].islower() and prior < SMALL_PRIOR:
                yield "lower", a, b, low, "", "", "", 0.0, 0.0
                continue
            if prior <= NO_PRIOR:
                continue
            r1, j = near(i, 1, True)
            l1, k = near(i, -1, True)
            l2 = near(k, -1, True)[0] if l1 != "<b>" else "<b>"
            r1 = "<b>" if opens(j) else r1
            r2 = near(j, 1, True)[0] if r1 != "<b>" else "<b>"
            for part in {low, *low.split("-")} if "-" in low else (low,):
                if len(part) > 1:
                    yield "person_name", a, b, part, l1, f"{l2} {l1}", f"{r1} {r2}", prior, first
    if not t.isascii():
        for m in P.UNSPACED_NAME.finditer(t):
            a, b = m.span(m.lastindex)
            yield "person_name", a, b, t[a:b], t[m.start() : a] or "<b>", "<b>", "<b> <b>", 0.85, 0.0


def occurrences(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, lower) of texts (tbl, row_id, text): every candidate place, and how often each word is written small
    in texts that use capitals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tbl", "row_id", "kind", "start", "end", "inst", "l1", "l2", "r1", "prior", "prior2"]
        for batch in batches:
            rows = []
            small: Counter = Counter()
            for tbl, row, text in batch.itertuples(index=False, name=None):
                for kind, a, b, *rest in extract(text):
                    if kind == "lower":
                        small[rest[0]] += 1
                    else:
                        rows.append((tbl, row, kind, a, b, *rest))
            rows += [("", n, "lower", 0, 0, w, "", "", "", 0.0, 0.0) for w, n in small.items()]
            yield pd.DataFrame(rows, columns=names)

    schema = "tbl string, row_id long, kind string, start int, end int, inst string, l1 string, l2 string, r1 string, prior double, prior2 double"
    found = cut(texts.where("text is not null").select("tbl", "row_id", "text").mapInPandas(run, schema))
    lower = found.where("kind = 'lower'").groupBy("inst").agg(F.sum("row_id").alias("small"))
    return found.where("kind <> 'lower'"), lower


def _setting(n: int) -> Column:
    return F.create_map(*(F.lit(x) for k, v in SETTINGS.items() for x in (k, v[n])))[F.col("k")]


def _rounds(units: DataFrame, rounds: int) -> DataFrame:
    """(uid, score, told) of the graph of patterns and instances: units (uid, k, inst, n, l1, l2, r1, seed), one for each
    instance in its patterns; ``seed`` is 1 for seed entities, 0 for what is known to be none, and null for the unknown.

    A pattern's score is the share of seeds and accepted units among its units, each by the logarithm of how often
    it occurs, unknown ones at a discount. A unit scores by its patterns that hold anything known, those to the left
    foremost; an instance by the mean of its units. At the start of a text, where no pattern can stand to the left, the
    instance speaks. A unit's score is its own and, by a share, that of its instance. What reaches SURE counts as known
    in the next round; seeds keep their scores. ``told`` weighs what the unit's patterns were learned from, that of two
    words in full. The kinds are scored side by side, each in patterns of its own.
    """
    open_end = lambda c: F.col(c).contains("<b>") | F.col(c).contains("<item>")
    right = F.element_at(F.split("r1", " "), 1)
    named = F.col("k") == "person_name"
    pattern = lambda side, c, when: F.when(when, F.struct(F.lit(side).alias("side"), F.xxhash64(F.col("k"), F.lit(side), c).alias("f")))
    patterns_of = F.array_compact(F.array(pattern("l1", F.col("l1"), F.col("l1") != "<b>"), pattern("l2", F.col("l2"), ~open_end("l2")), pattern("r1", right, named & (right != "<b>") & ~right.isin(sorted(P.NEVER))), pattern("r2", F.col("r1"), ~open_end("r1"))))
    units = units.withColumn("w", F.log1p("n"))
    edges = cut(units.select("uid", "k", "w", F.explode(patterns_of).alias("p")).select("uid", "k", "w", "p.side", "p.f"))
    kept = units.select("uid", "k", F.xxhash64("k", "inst").alias("inst"), "w", "seed", (F.col("l1") == "<b>").alias("edge"))
    state = kept.select("uid", F.col("seed").alias("s"))
    on_left = F.col("side").startswith("l")
    for turn in range(rounds):
        weight = F.when(F.col("s").isNull(), F.col("w") * _setting(1)).otherwise(F.col("w"))
        known = F.sum(F.when(F.col("s").isNotNull(), F.col("w")))
        told = edges.join(state.select("uid", "s"), "uid").groupBy("f").agg((F.sum(F.col("w") * F.coalesce("s", F.lit(0.0))) / (F.sum(weight) + DOUBT)).alias("p"), known.alias("told"), F.sum("w").alias("mass"))
        heard = F.when(F.col("told").isNotNull(), F.col("p"))
        by_unit = edges.join(told, "f").groupBy("uid").agg(
            F.max(F.when(on_left, F.coalesce(heard, F.lit(0.0)))).alias("left"),
            F.max(F.when(~on_left, heard)).alias("right"),
            F.max(F.when(on_left, heard)).alias("left_heard"),
            F.max(F.when((F.col("side") == "l2") & F.col("told").isNull(), F.col("mass"))).alias("mute"),
            F.sum(F.when(F.col("side").isin("l2", "r2"), F.log1p(F.col("mass") - F.col("w")))).alias("far"),
            F.sum(F.when(F.col("side") == "l1", F.col("told"))).alias("close"),
        )
        # what stands to the left tells more; the right side alone counts in full only where nothing stands there
        own = F.when(F.col("left").isNull(), F.col("right")).when(F.coalesce("left_heard", "right").isNotNull(), F.greatest(F.col("left"), F.coalesce("right", F.lit(0.0)) * _setting(2)))
        # a longer pattern to the left that occurs often and never with anything known speaks against the shorter one
        own = own / (1.0 + _setting(4) * F.coalesce("mute", F.lit(0.0)))
        scored = kept.join(by_unit, "uid", "left").withColumn("own", own)
        insts = scored.groupBy("inst").agg((F.sum(F.col("w") * F.col("own")) / (F.sum(F.when(F.col("own").isNotNull(), F.col("w"))) + DOUBT / 2)).alias("inst_score"))
        inst = F.coalesce("inst_score", F.lit(0.0))
        bare = F.col("left").isNull() & F.col("right").isNull() & F.col("far").isNull()
        mixed = F.when(F.col("edge"), F.greatest(F.coalesce("own", F.lit(0.0)), inst * _setting(3))).when(bare, inst).otherwise(F.coalesce("own", F.lit(0.0)) * (1 - _setting(0)) + inst * _setting(0))
        score = F.coalesce("seed", mixed)
        evidence = F.coalesce("far", F.lit(0.0)) + F.least(F.lit(CLOSE), 0.3 * F.log1p(F.coalesce("close", F.lit(0.0))))
        state = scored.join(insts, "inst").select("uid", score.alias("score"), evidence.alias("told"), F.when(F.col("seed").isNotNull() | (score >= SURE), score).alias("s"))
        state = cut(state)
    return state.select("uid", "score", "told")


def classify(places: DataFrame, lower: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tbl, row_id, kind, start, end) of the personal items among the candidate places."""
    keys = ["inst", "l1", "l2", "r1", "prior", "prior2"]  # in r1 the two words to the right, in l2 those to the left
    kinds = F.when(F.col("kind") == "number", F.array(F.struct(F.lit("phone").alias("k"), F.col("prior").alias("q")), F.struct(F.lit("id_number").alias("k"), F.col("prior2").alias("q")))).otherwise(F.array(F.struct(F.col("kind").alias("k"), F.col("prior").alias("q"))))
    place = F.xxhash64("kind", *keys)
    groups = cut(places.groupBy("kind", *keys).agg(F.count("*").alias("n")).withColumn("place", place))
    opening = F.sum(F.when(F.col("prior2") == 1.0, F.col("n")).otherwise(0))
    totals = groups.where("kind = 'person_name'").groupBy("inst").agg(F.sum("n").alias("all"), opening.alias("opening"))
    small = F.coalesce("small", F.lit(0))
    common = F.when((F.col("all") >= OPENS_LEAST) & (F.col("opening") >= OPENS_SHARE * F.col("all")), 1.0).otherwise(0.0)
    share = totals.join(lower, "inst", "left").select("inst", F.greatest(common, F.when(small > 3, small / (F.col("all") + small)).otherwise(0.0)).alias("small_share"))
    named = F.col("k") == "person_name"
    units = groups.join(share, "inst", "left").select("place", "inst", "l1", "l2", "r1", "n", F.col("prior2").alias("first"), F.coalesce("small_share", F.lit(0.0)).alias("small_share"), F.explode(kinds).alias("u")).select("*", "u.k", "u.q").drop("u")
    # words that are also written small, or mostly open sentences, are common words; only a place that surely holds a name speaks for them
    units = units.withColumn("q", F.when(named & (F.col("small_share") >= 0.2) & (F.col("q") < 0.9), F.col("q") * 0.1).otherwise(F.col("q")))
    phone_form, id_form = F.col("inst").startswith("phone/"), F.col("inst").startswith("id_number/")
    seed = (
        F.when(F.col("k") == "phone", F.when(phone_form, 1.0).when(id_form, 0.0))
        .when(F.col("k") == "id_number", F.when(id_form, 1.0).when(phone_form, 0.0))
        .when(named, F.when((F.col("small_share") >= 0.2) & (F.col("q") < 0.9), 0.0).when(F.col("inst").isin(sorted(P.SEED_NAMES)) & (F.col("q") >= FIT_PRIOR) | (F.col("q") >= SEED_PRIOR + 0.03), 1.0))
        .otherwise(F.when(F.col("q") >= SEED_PRIOR, 1.0))
    )
    units = cut(units.withColumn("seed", seed).withColumn("uid", F.xxhash64("place", "k")))
    state = _rounds(units, rounds)
    blend = (F.col("told") * F.col("score") + BACK_OFF * F.col("q")) / (F.col("told") + BACK_OFF)
    # a number in a phone format that no pattern speaks against is a phone number
    plain = F.element_at(F.split("inst", "/"), 2).rlike(r"^(3[- .]3[- .]4|1[- .]3[- .]3[- .]4|3-4|10)$")
    alone = F.col("l1").isin("<b>", "<item>") | (F.col("score") >= 0.2)
    # one word beside a number tells little against its form
    # and so does what follows a capital that opens a sentence
    unsure = F.when(named, (F.col("first") > 0) & (F.col("q") <= DOUBTFUL)).otherwise((F.col("told") <= CLOSE) & (F.col("q") <= UNLIKELY))
    final = F.greatest(F.when(unsure, blend).otherwise(F.col("score")), blend, F.when((F.col("k") == "phone") & plain & alone, 0.55))
    told = units.select("uid", "place", "k", "q", "inst", "l1", "first").join(state, "uid").select("place", "k", final.alias("final"))
    least = F.when(named, ACCEPT_NAME + F.lit(0.0)).otherwise(ACCEPT)
    rank = F.when(F.col("k") == "id_number", 1).otherwise(0)
    sure = told.where(F.col("final") >= least).groupBy("place").agg(F.max_by("k", F.struct("final", rank)).alias("k"))
    items = places.withColumn("place", place).join(sure, "place").select("tbl", "row_id", F.col("k").alias("kind"), "start", "end")
    people = F.col("kind") == "person_name"  # parts of a name with a hyphen stand for the whole
    return items.where(~people).unionByName(items.where(people).distinct())


def find_items(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tbl, row_id, kind, start, end) of the personal items in texts (tbl, row_id, text); positions in code points.

    Null and empty texts have none. Repeated rows give their numbers and addresses each, their names once. Patterns are learned from the texts given: jobs run while
    the plan is built.
    """
    return classify(*occurrences(texts), rounds)


def redact(texts: DataFrame, items: DataFrame) -> DataFrame:
    """texts (tbl, row_id, text) with every item replaced by ``[KIND]``; neighbouring parts of one name become one
    placeholder. Everything else stays as it is; null stays null. (tbl, row_id) must be unique in ``texts``."""
    spans = items.groupBy("tbl", "row_id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    joined = texts.select("tbl", "row_id", "text").join(spans, ["tbl", "row_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = pd.Series([_replace(t, s) for t, s in zip(b["text"], b["spans"], strict=True)], dtype=object, index=b.index)
            yield b[["tbl", "row_id", "text"]]

    return joined.mapInPandas(run, "tbl string, row_id long, text string")


def _replace(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    merged: list[list] = []
    for a, b, k in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        gap = text[merged[-1][1] : a] if merged else ""
        if merged and k == merged[-1][2] and (a <= merged[-1][1] or k == "person_name" and re.fullmatch(r"(?:[\s,]|\b\w\.?(?=\s)|\b(?:van|der|de|la|von|ní)\b)+", gap) and "\n" not in gap):
            merged[-1][1] = max(merged[-1][1], b)
        elif not merged or a >= merged[-1][1]:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
