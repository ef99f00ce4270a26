"""Sentence units of documents in any language and script.

Blank lines always end a unit. Within a paragraph every place where a sentence could end (a mark, or in Thai a
blank) is a candidate, and semi-Markov dynamic programming picks the set of whole spans whose scores add up best.
A span is scored by its length, the word it opens with and the word it closes with; none ends inside paired quotation
marks or brackets. What opens and closes sentences is learned from the corpus itself, without labels:
words next to the edges of paragraphs surely open or close one, and are weighed against all their candidates.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut

#: Words of the model that are sent to every executor, those with most candidates; the counts of all others reach
#: the documents that hold them by a join.
MODEL_WORDS = 200_000
LEAST_COUNT = 3
LOW_SHARE = 0.15
#: Weight of the prior of a word's shape, in occurrences.
PRIOR_WEIGHT = 4.0
#: Log-odds of one side are kept within this bound.
BOUND = 4.0
#: Middle, spread and weight of the length score.
LENGTH_MEDIAN, LENGTH_SPREAD, LENGTH_WEIGHT = 70.0, 1.3, 0.3

#: Starts of a span from which they are scored as one array.
MANY_STARTS = 64

_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r ])[^\S\n\r]*(?:(?:\r\n|[\n\r ])\s*)+| \s*")
#: Marks that close, or where nothing but white space follows, marks that close in some languages and open in others.
_CLOSING = r"(?:[\"'”’»」』）)\]】》〉]|[“«›](?=\s|$))"
_CANDIDATE = re.compile(
    r"(?P<full>[。！？｡]+)(?P<c1>" + _CLOSING + r"*)(?P<g1>\s*)"
    r"|(?P<mark>[.!?…‥؟۔।॥։።]+|(?<=[Ͱ-Ͽἀ-῿]);)(?P<c2>" + _CLOSING + r"*)(?P<g2>\s*)"
    r"|(?P<g4>(?:(?<=[฀-๿])\s+|\s+(?=[฀-๿])))"
)
#: A sign that any candidate but a Thai blank begins with.
_SIGN = re.compile("[。！？｡.!?…‥؟۔।॥։;]")
_OPEN, _CLOSE = "([{（【「『《〈«„", ")]}）】」』》〉»“"
_PAIR = dict(zip(_OPEN, _CLOSE, strict=True))
_MARKS = re.compile("[" + re.escape(_OPEN + _CLOSE) + "\"“”]")
_LEAD = re.compile(r"[\"'“”‘’«»„(\[{（「『《¿¡\s]*")
_WORD = re.compile(r"[^\W_]+(?:[-'’.][^\W_]+)*")
_SIX, _MARKED = re.compile(r"\S{1,6}"), re.compile(r"[^\s.,;:!?।]+")
_END_MARKS = "\"'”’“»«›」』）)]】》〉"
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿。！？、「」『』（）]+(?=[^぀-ヿ㐀-鿿])")
_VOWEL = re.compile(r"[aeiouyàâäáéèêëíìîïóòôöúùûüαεηιουωάέήίόύώаеёиоуыэюя]")


def _script(ch: str) -> str:
    if ch.isascii():
        return "cased" if ch.isalpha() else "digit" if ch.isdigit() else "other"
    if "฀" <= ch <= "๿":
        return "thai"
    if "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿":
        return "cjk"
    return "cased" if ch.upper() != ch.lower() else "digit" if ch.isdigit() else "other"


def _depths(text: str) -> list[tuple[int, int]]:
    """(position, change of nesting) of every quotation mark or bracket that has a partner."""
    stack: list[tuple[str, int]] = []  # what would close each open mark, and where it stands
    waiting: Counter = Counter()
    pairs = []
    for m in _MARKS.finditer(text):
        c, i = m[0], m.start()
        if c in _PAIR or c in '"“' and not waiting[c]:
            stack.append((_PAIR.get(c) or ("”" if c == "“" else '"'), i))
            waiting[stack[-1][0]] += 1
        elif waiting[c]:
            while stack:  # marks inside that never closed have no partner
                want, at = stack.pop()
                waiting[want] -= 1
                if want == c:
                    pairs.append((at, i))
                    break
    return sorted([(a, 1) for a, _ in pairs] + [(b, -1) for _, b in pairs])


def _opening(text: str, at: int) -> str:
    """What the text at ``at`` opens with: a word as written, a number, or the first signs of unspaced scripts."""
    at = _LEAD.match(text, at).end()
    if at >= len(text):
        return ""
    if text[at].isdigit():
        m = _WORD.match(text, at)
        return "0" if m is None or m[0].isdigit() or not any(c.isalpha() for c in m[0]) else _DIGITS.sub("0", m[0])
    s = "cased" if text[at].isascii() else _script(text[at])
    if s == "cjk":
        return text[at : at + 2]
    if s == "thai":
        return _SIX.match(text, at)[0]
    # marks within words (Indic scripts) are no word characters of the engine
    m = _WORD.match(text, at) or _MARKED.match(text, at)
    return m[0] if m else text[at]


def _closing(text: str, end: int, start: int) -> str:
    """What the text up to ``end`` closes with: its last word with its mark, lower case, digits as 0; of scripts
    without blanks the last six signs."""
    while end > start and text[end - 1] in _END_MARKS:
        end -= 1
    reach = 24
    while True:
        tail = text[max(start, end - reach) : end]
        cut_off = tail.rsplit(None, 1)
        if len(cut_off) == 2 or end - reach <= start:
            break
        reach *= 2
    last = (cut_off or [""])[-1]
    if not last.isascii():
        # a word in letters need not be set off by a blank from unspaced script before it
        last = _UNSPACED.split(last)[-1] or last
        if _THAI.search(last) or _CJK.search(last[-2:]):
            return last[-6:]
    last = _LEAD.sub("", last, count=1)
    return _DIGITS.sub("0", last.lower())


def _class(word: str) -> str:
    return "thai" if _THAI.search(word) else "cjk" if _CJK.search(word) else "all"


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between blank lines, without white space around them."""
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b
        if m:
            at = m.end()


def _matches(text: str, a: int, b: int) -> Iterator[re.Match]:
    if _THAI.search(text, a, b):
        yield from _CANDIDATE.finditer(text, a, b)
        return
    for sign in _SIGN.finditer(text, a, b):
        if sign.start() >= a and (m := _CANDIDATE.match(text, sign.start(), b)):
            a = m.end()
            yield m


def candidates(text: str, a: int, b: int) -> list[tuple[int, int, str, str, int, str]]:
    """(end, next start, closing, opening, depth, kind) of every place in text[a:b] where a sentence could end."""
    marks, k, depth, out = _depths(text[a:b]), 0, 0, []
    for m in _matches(text, a, b):
        kind = m.lastgroup
        if m["full"]:
            end, nxt = m.end("c1"), m.end("g1")
            kind = "fullq" if any(c in "\"”»“’」』" for c in m["c1"]) else "full"
        elif m["mark"]:
            end, nxt = m.end("c2"), m.end("g2")
            kind = "stop" if set(m["mark"]) <= set(".…‥") else "mark"
            if m["c2"] and any(c in "\"”»“’" for c in m["c2"]):
                kind += "q"
            if nxt == end and not _may_follow(text, m.start(), end, b):
                continue
        else:
            end, nxt, kind = m.start(), m.end(), "blank"
        if nxt >= b or end <= a:
            continue
        while k < len(marks) and marks[k][0] + a < end:
            depth += marks[k][1]
            k += 1
        out.append((end, nxt, _closing(text, end, a), _opening(text, nxt), depth, kind))
    return out


def _may_follow(text: str, mark: int, end: int, stop: int) -> bool:
    """Whether a sentence may begin right at ``end``, without a space after the mark."""
    before, nxt = text[mark - 1 : mark], text[end : end + 1]
    if not before or before.isspace() or before in ".!?":
        return False
    if nxt in "¿¡«“„「『":
        return True
    if nxt == '"':
        return end == mark + 1 and text[end + 1 : end + 2].isupper()
    if not nxt.isalpha():
        return False
    s = _script(nxt)
    if s != "cased":
        return _script(before) == s or before.isdigit() or not before.isalnum()
    word = _WORD.match(text, end)[0]
    if text[mark] == "." and mark >= 2 and before.isalpha() and not text[mark - 2].isalnum():
        return False  # an initial or an abbreviation of single letters
    if nxt.isupper():
        return len(word) == 1 or not word[1] == "." or word[1:2].islower()
    return any(c.isupper() or c.isdigit() for c in word[1:]) and "." not in word


def _shape_open(word: str) -> float:
    """Share of a word of unknown history that opens a sentence after a possible end."""
    if not word:
        return 0.5
    s = _script(word[0])
    if s == "cased":
        return 0.75 if word[0].isupper() else 0.25 if any(c.isupper() or c.isdigit() for c in word[1:]) else 0.02
    return {"digit": 0.3, "thai": 0.3}.get(s, 0.5)


def _shape_close(word: str) -> float:
    body = word.rstrip(".…")
    if word.endswith(("...", "…")):
        return 0.3
    if not word.endswith("."):
        return 0.3 if _THAI.search(word) else 0.8
    if "." in body or len(body) <= 1 and not body.isdigit():
        return 0.2
    if body.isdigit() or not body[-1:].isalpha():
        return 0.7
    if _script(body[-1]) == "cased" and (len(body) <= 3 or not _VOWEL.search(body)):
        return 0.4
    return 0.85


def learn(docs: DataFrame, text: str) -> dict:
    """The model of the words with most candidates."""
    return _learn(docs, text)[0]


def _learn(docs: DataFrame, text: str) -> tuple[dict, DataFrame | None]:
    """Counts of opening and closing words over all documents, reduced to the model: log-odds by word, and the counts
    (side, word, hits, total) of the words beyond the first MODEL_WORDS, if there are any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits: Counter = Counter()
        total: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*w, hits[w], n) for w, n in total.items()], columns=["side", "word", "hits", "total"])
            hits.clear()
            total.clear()
            return out

        for batch in batches:
            for t in batch["t"]:
                for a, b in paragraphs(t):
                    first, last = ("open", _opening(t, a)), ("close", _closing(t, b, a))
                    total[first] += 1
                    hits[first] += 1
                    if _class(last[1]) == "thai" or last[1].endswith("."):
                        total[last] += 1
                        hits[last] += 1
                    for _, _, x, y, depth, kind in candidates(t, a, b):
                        if depth:
                            continue
                        total["open", y] += 1
                        if kind in ("mark", "full"):
                            # a mark other than the full stop is sure enough, unless a small letter follows
                            hits["open", y] += not y[:1].islower()
                        else:
                            total["close", x] += 1
            if len(total) > 200_000:
                yield flush()
        yield flush()

    chosen = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    counts = cut(chosen.mapInPandas(count, "side string, word string, hits long, total long").groupBy("side", "word").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).where(F.col("total") >= LEAST_COUNT))
    # words that always open (close) sentences have about one share of sure cases; most hits are theirs, so a low
    # quantile of the shares, by hits, lies below nearly all of them and above the words that rarely do
    cls = F.when(F.col("word").rlike(_THAI.pattern), "thai").when(F.col("word").rlike(_CJK.pattern), "cjk").otherwise("all")
    shares = counts.where("hits > 0").groupBy("side", cls.alias("cls"), F.round(F.col("hits") / F.col("total"), 4).alias("share")).agg(F.sum("hits").alias("hits")).collect()  # at most 60,006 rows
    rate = {}
    for side in ("open", "close"):
        for kind in ("all", "thai", "cjk"):
            own = sorted((r.share, r.hits) for r in shares if r.side == side and r.cls == kind)
            part, enough = 0, sum(h for _, h in own) * LOW_SHARE
            rate[side, kind] = 0.2
            for share, h in own:
                part += h
                if part >= enough:
                    rate[side, kind] = max(share, 0.0001)
                    break
    top = counts.orderBy(F.desc("total"), "side", "word").limit(MODEL_WORDS).collect()
    model: dict = {"open": {}, "close": {}, "rate": rate}
    for r in top:
        model[r.side][r.word] = _odds(rate, r.side, r.word, r.hits, r.total)
    if len(top) < MODEL_WORDS:
        return model, None
    last = F.struct((-F.lit(top[-1].total)).alias("total"), F.lit(top[-1].side).alias("side"), F.lit(top[-1].word).alias("word"))
    return model, counts.where(F.struct((-F.col("total")).alias("total"), "side", "word") > last)


def _odds(rate: dict, side: str, word: str, hits: int, total: int) -> float:
    shape = _shape_open(word) if side == "open" else _shape_close(word)
    base = rate[side, _class(word)]
    p = min((hits + PRIOR_WEIGHT * shape * base) / (total + PRIOR_WEIGHT) / base, 0.999)
    # many candidates and never a sure one speak louder than the ratio alone
    return max(-BOUND, min(BOUND, math.log(p / (1 - p))))


def _weight(model: dict, x: str, y: str, kind: str) -> float:
    def odds(side: str, word: str, by_shape) -> float:
        known = model[side].get(word)
        if known is None:
            shape = by_shape(word)
            return math.log(shape / (1 - shape))
        return known

    opens = odds("open", y, _shape_open)
    if kind == "full":
        return 8.0
    if kind == "mark":
        return 5.0 + min(opens, 0.0) * 1.2
    if kind in ("fullq", "markq"):  # the sentence may go on and report what was quoted
        return opens * 1.5 - 0.5
    closes = odds("close", x, _shape_close)
    if kind == "blank":
        return opens + closes - 0.5
    return opens + closes


def sentences(text: str, model: dict) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of ``text``."""
    out = []
    for a, b in paragraphs(text):
        spots = []
        for end, nxt, x, y, depth, kind in candidates(text, a, b):
            if depth:  # what stands in paired marks is not divided, however many sentences it has
                continue
            w = _weight(model, x, y, kind)
            if w > -BOUND - 0.5:
                spots.append((end, nxt, w))
        out += _select(a, b, spots)
    return out


def _select(a: int, b: int, spots: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    starts = [a, *(s for _, s, _ in spots)]
    ends = [*(e for e, _, _ in spots), b]
    gain = [*(w for _, _, w in spots), 0.0]
    n = len(ends)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    firsts, scores = np.array(starts, dtype=np.float64), np.full(n + 1, -np.inf)  # starts and best as arrays
    scores[0] = 0.0
    sure = 0  # no span reaches over a candidate this strong
    for j in range(n):
        many = j + 1 - sure > MANY_STARTS
        if many:
            length = ends[j] - firsts[sure : j + 1]
            z = (np.log(np.maximum(length, 1.0)) - math.log(LENGTH_MEDIAN)) / LENGTH_SPREAD
            s = np.where(length > 0, scores[sure : j + 1] + gain[j] - LENGTH_WEIGHT * z * z / 2, -np.inf)
            i = int(s.argmax())
            if s[i] > -math.inf:
                best[j + 1], back[j + 1] = float(s[i]), sure + i
        for i in () if many else range(sure, j + 1):
            length = ends[j] - starts[i]
            if length <= 0:
                continue
            z = (math.log(length) - math.log(LENGTH_MEDIAN)) / LENGTH_SPREAD
            s = best[i] + gain[j] - LENGTH_WEIGHT * z * z / 2
            if s > best[j + 1]:
                best[j + 1], back[j + 1] = s, i
        scores[j + 1] = best[j + 1]
        if gain[j] > 6.5 and best[j + 1] > -math.inf:
            sure = j + 1
    out, j = [], n
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def split_sentences(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row ``(<id_column>, start_pos, end_pos)`` per sentence of each text: code points from 0, end exclusive,
    no white space at either edge.

    Null, empty and blank texts have no sentences; a text without any mark is one. Repeated rows give theirs each.
    Other columns play no part. The model is learned from the texts given, by jobs that run while the plan is built.
    """
    model, rest = _learn(docs, text)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, start_pos int, end_pos int"
    chosen = docs.select(F.col(f"`{id_column}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, a, b) for d, t in zip(batch["d"], batch["t"], strict=True) for a, b in sentences(t, held.value)]
            yield pd.DataFrame(rows, columns=[id_column, "start_pos", "end_pos"])

    if rest is None:
        return chosen.mapInPandas(run, schema)

    def unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                places = [c for a, b in paragraphs(t) for c in candidates(t, a, b) if not c[4]]
                words = {("close", c[2]) for c in places} | {("open", c[3]) for c in places}
                rows += [(k, side, w) for side, w in words if w not in model[side]]
            yield pd.DataFrame(rows, columns=["k", "side", "word"])

    def run_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            rows = []
            for d, t, more in zip(batch["d"], batch["t"], batch["more"], strict=True):
                own = {"open": {}, "close": {}}
                for r in more if more is not None else ():
                    own[r["side"]][r["word"]] = _odds(model["rate"], r["side"], r["word"], r["hits"], r["total"])
                here = {"open": ChainMap(own["open"], model["open"]), "close": ChainMap(own["close"], model["close"])} if more is not None else model
                rows += [(d, a, b) for a, b in sentences(t, here)]
            yield pd.DataFrame(rows, columns=[id_column, "start_pos", "end_pos"])

    # a document asks for the words that were not sent, and gets their counts by a join: no word is without its own
    keyed = cut(chosen.withColumn("k", F.monotonically_increasing_id()))
    asked = keyed.select("k", "t").mapInPandas(unknown, "k long, side string, word string")
    answered = asked.join(rest, ["side", "word"]).groupBy("k").agg(F.collect_list(F.struct("side", "word", "hits", "total")).alias("more"))
    return keyed.join(answered, "k", "left").select("d", "t", "more").mapInPandas(run_with, schema)
