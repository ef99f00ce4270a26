import re

from termloom.operators.packed import unpack

CASES = {
    'C0001461\nC0001353': ["C0001461", "C0001353"],
    ';C1=a ;"C2 ""x | y"" note" ;"C3=b; c, d" ;c4': ["C1=a", 'C2 "x | y" note', "C3=b; c, d", "c4"],
    '["C1", "C2"]': ["C1", "C2"],
    "C1 (neuropathy, tongue); C2 C3  C4": ["C1 (neuropathy, tongue)", "C2", "C3", "C4"],
    "C1=acute thing C2": ["C1=acute thing C2"],
    "SNO:51757820,C0001193": ["SNO:51757820", "C0001193"],
    " , ;; ": [],
    "": [],
    None: [],
    'C1||C2|"open': ["C1", "C2", '"open'],
    "a0;x;3": ["a0", "x", "3"],
    "C1\tC2=q r": ["C1", "C2=q r"],
}


def test_split(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, f string, field string")
    got = {}
    for r in unpack(df, "row_id", ["f"]).collect():
        got.setdefault(r.row_id, {})[r.pos] = r.val
        assert r.field == "f"
    for i, t in enumerate(CASES):
        values = got.get(i, {})
        assert sorted(values) == list(range(1, len(values) + 1))
        assert [values[p] for p in sorted(values)] == CASES[t], repr(t)


def brute(text):
    """A character scanner, unlike the operator in every way."""
    if text is None:
        return []
    if (m := re.fullmatch(r"\s*\[(.*)\]\s*", text, re.S)):
        text = m[1]
    pieces, now, i = [], "", 0
    while i < len(text):
        m = re.compile(r'"(?:[^"]|"")*"|\((?:[^()"]|"(?:[^"]|"")*")*\)').match(text, i)
        if m:
            now, i = now + m[0], m.end()
        elif text[i] in ";,|\t\r\n":
            pieces.append(now)
            now, i = "", i + 1
        else:
            now, i = now + text[i], i + 1
    out = []
    for p in [*pieces, now]:
        words = p.split()
        for k, w in enumerate(words):
            bare = lambda x: re.fullmatch(r"[A-Za-z]+[:_]?[0-9]+", x)
            if k and not (bare(w) and bare(words[k - 1])):
                out[-1] += None or re.search(re.escape(words[k - 1]) + r"(\s+)" + re.escape(w), p)[1] + w
            else:
                out.append(w)
    return [re.sub('""', '"', v[1:-1]).strip() if re.fullmatch(r'"(?:[^"]|"")*"', v, re.S) else v for v in out if v]


def test_real_rows_against_a_scanner(spark, small):
    df = spark.read.parquet(f"{small}/search_quality_patient_portal_queries.parquet")
    fields = ["expected_cuis", "disallowed_cuis", "context_cuis"]
    got = {}
    for r in unpack(df, "row_id", fields).collect():
        got.setdefault((r.row_id, r.field), []).append((r.pos, r.val))
    for r in df.collect():
        for f in fields:
            assert [v for _, v in sorted(got.get((r.row_id, f), []))] == [v for v in brute(r[f]) if v], r[f]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "row_id long, f string")
    assert unpack(df, "row_id", ["f"]).count() == 0
    df = spark.createDataFrame([(1, "a;b"), (1, "a;b")], "row_id long, f string")
    assert unpack(df, "row_id", ["f"]).count() == 4


def test_long_field(spark):
    df = spark.createDataFrame([(1, ";".join(f'"v;{i}"' for i in range(20000)))], "row_id long, f string")
    assert unpack(df, "row_id", ["f"]).count() == 20000


def test_nested_brackets_stay_together(spark):
    rows = [(1, "C1 (a; (b; c); d); C2"), (2, "x (1, (2, (3, 4)), 5), y"), (3, 'p (q; "(r"; (s; t)); u'), (4, "open (a; (b; c); d"), (5, "(" * 12 + "a;b" + ")" * 12 + ";z"), (6, "(" * 3000)]
    got = {}
    for r in unpack(spark.createDataFrame(rows, "i long, f string"), "i", ["f"]).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append(r.val)
    assert got[1] == ["C1 (a; (b; c); d)", "C2"] and got[2] == ["x (1, (2, (3, 4)), 5)", "y"] and got[3] == ['p (q; "(r"; (s; t))', "u"]
    assert got[4] == ["open (a", "(b; c)", "d"] and got[5] == ["(" * 12 + "a;b" + ")" * 12, "z"] and got[6] == ["(" * 3000]
