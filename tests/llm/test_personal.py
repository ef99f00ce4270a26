import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termloom.llm.personal import KINDS, _replace, extract, find_items, flat, redact
from termloom.llm.personal_forms import seed_kind
from termloom.llm.queries import _texts

from personal_sentences import FRESH, HELD_OUT, parse

GIVEN = ["Wren", "Orla", "Tobin", "Thomas", "Anna", "Maria", "Daniel", "Samuel"]
FAMILY = ["Quarrow", "Tinsley", "Bramhall", "Oakden"]


def corpus():
    rows = []
    for i in range(160):
        g, f = GIVEN[i % 8], FAMILY[i // 8 % 4]
        rows += [f"My name is {g} {f}.", f"This is {g} writing.", f"patient {g.lower()} {f.lower()} chart", f"Can pain come from {f.lower()[::-1]}ine?"]
        rows += [f"Reach me at (212) 555-01{i % 90:02d} after 5.", f"Reach me at 312 555 01{i % 90:02d} after 5.", f"lot 229-555-{1000 + i} recall", f"The order was 4487-233-{6000 + i}."]
        rows += [f"My SSN 9{i % 90:02d}-12-34{i % 90:02d} is on the form.", f"My MRN 393{i:05d} is on the form.", f"mrn 771{i:05d}", f"The article PMID 871{i:05d} says so."]
        rows += [f"Hallowick's sign and {f} syndrome were ruled out.", f"a {f} score of {i}"]
    return rows + ["Write to orla.oakden [at] post dot example please", "Ｒeach me at ３１２ ５５５ ０１２３", "We live at 402 Nine Elms Court, Unit 13, Ostermouth, is there a clinic?", "It was Tobin Quarrow who drove.", "I walked 6 blocks down the street", "keep taking it @ 12.5 mg"]


def frame(spark, rows):
    return spark.createDataFrame([("t", i, r, "x") for i, r in enumerate(rows)], "tbl string, row_id long, text string, kind string")


def test_kinds(spark):
    rows = corpus()
    texts = frame(spark, rows)
    items = find_items(texts)
    got = {}
    for r in items.select("row_id", "kind").distinct().collect():
        got.setdefault(r.row_id, set()).add(r.kind)
    for i, t in enumerate(rows):
        want = (
            {"person_name"} if t.startswith(("My name", "This is", "patient", "It was")) else {"phone"} if t.startswith(("Reach", "Ｒ")) else {"id_number"} if "SSN" in t or "mrn" in t.lower()
            else {"email"} if "[at]" in t else {"address"} if "Nine" in t else set()
        )
        assert got.get(i, set()) == want, t
    out = {r.row_id: r.text for r in redact(texts, items).collect()}
    assert len(out) == len(rows)
    assert out[0].startswith("My name is [PERSON_NAME]") and out[4] == "Reach me at [PHONE] after 5." and out[len(rows) - 6] == "Write to [EMAIL] please"
    assert all(out[i] == t for i, t in enumerate(rows) if i not in got)


def test_odd_rows(spark):
    texts = spark.createDataFrame([("t", 1, None), ("t", 2, ""), ("t", 3, "word " * 60_000), ("t", 4, "1" * 5000)], "tbl string, row_id long, text string")
    items = find_items(texts)
    assert {r.row_id: r.text for r in redact(texts, items).collect()}[1] is None
    assert items.where("row_id in (1, 2, 3)").count() == 0
    assert find_items(texts.limit(0)).count() == 0
    doubled = texts.limit(0).unionByName(spark.createDataFrame([("t", 1, "a@b.example")] * 2, texts.schema)).withColumn("start", F.lit(0))
    assert find_items(doubled).count() == 2


def test_pieces_of_one_name_and_plain_parts():
    text = "Dr. Anna B. van der Quell, Tobin 5"
    spans = [{"start": 4, "end": 8, "kind": "person_name"}, {"start": 20, "end": 25, "kind": "person_name"}, {"start": 27, "end": 32, "kind": "person_name"}]
    assert _replace(text, spans) == "Dr. [PERSON_NAME] 5"
    assert flat("０1") == "01" and seed_kind("+44 7700 900748") == "phone" and seed_kind("229-555-2489") == ""
    assert {x[0] for x in extract("x@ y.z 6 blocks down the street")} <= {"name"}


def _measured(spark, folder, *blocks):
    """{kind: (marked, of them found, found, of them marked)} of hand-made sentences among the texts of ``folder``."""
    rows = [r for block in blocks for r in parse(block)]
    texts = spark.createDataFrame([("hand", i, t) for i, (t, _) in enumerate(rows)], "tbl string, row_id long, text string")
    both = texts.unionByName(_texts(spark, folder))
    got: dict = {}
    for r in find_items(both).where("tbl = 'hand'").collect():
        got.setdefault(r.row_id, []).append((r.kind, r.start, r.end))
    out = {k: [0, 0, 0, 0] for k in KINDS}
    for i, (_, items) in enumerate(rows):
        for k in KINDS:
            want, have = [x[1:] for x in items if x[0] == k], [x[1:] for x in got.get(i, ()) if x[0] == k]
            meets = lambda x, ys: any(x[0] < d and c < x[1] for c, d in ys)
            for n, v in enumerate((len(want), sum(meets(x, have) for x in want), len(have), sum(meets(x, want) for x in have))):
                out[k][n] += v
    return out


def test_sentences_of_other_make(spark):
    """Names, numbers and addresses in frames that the corpus does not have: at least nine in ten, as often right."""
    for k, (marked, hit, found, right) in _measured(spark, "/root/testdata/sf0.01", HELD_OUT, FRESH).items():
        assert hit >= 0.9 * marked and right >= 0.9 * found, (k, marked, hit, found, right)


def test_no_list_decides_alone(spark):
    """Patterns of the corpus overrule what a number looks like, and a seed name needs a place fit for one."""
    rows = [f"Please quote zorbcode 212-555-{1000 + i} when ordering" for i in range(60)] + [f"Please quote zorbcode {i}{i}7731 when ordering" for i in range(10, 40)]
    rows += ["Lake Victoria is deep.", "Mark the calendar.", "We met Victoria there."]
    texts = frame(spark, rows)
    got = {(r.row_id, r.kind) for r in find_items(texts.drop("kind")).collect()}
    assert not [x for x in got if x[0] < 90] and not {(90, "person_name"), (91, "person_name")} & got and (92, "person_name") in got
