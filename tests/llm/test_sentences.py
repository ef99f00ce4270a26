import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm.sentences import learn, sentences, split_sentences

EMPTY = {"open": {}, "close": {}, "rate": {}}


@pytest.fixture(scope="module")
def model(spark, small):
    return learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text")


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Marrmere and Prof. Quillridge reviewed every image.", "Rates of cyst fell, e.g. by 3.4 per 100, in the U.S. and elsewhere.", "Was it really gout?!", "Yes."],
        ['One nurse wrote: "No pain today. Slept well." in the chart.', '"Is it safe?" asked one participant.', "Treatment was stopped for rash, etc.", "Mean calcium fell"],
        ["每日剂量为5.8毫克。", "这是否只是偶然？", "“头晕会复发吗？”一名患者问道。"],
        ["كانت الجرعة اليومية 4.1 ملغ.", "راجع د. سامر جميع الصور.", "هل يجب إيقاف الدواء؟"],
        ["डॉ. Keldick ने सभी चित्र देखे।", "किसी की मृत्यु नहीं हुई।"],
        ["ไม่พบผู้เสียชีวิต", "ขนาดยาเฉลี่ยเท่ากับ 9.1 มก. ต่อวัน", "ควรรับประทานยาหลังอาหาร"],
        ["Manche Wirkungen, z. B. Fieber, waren selten.", "Der Wert lag am 12. Tag bei 6,1 mmol/l."],
        ["Πρέπει να διακοπεί το φάρμακο;", "Ο κ. Quillridge είδε όλες τις εικόνες."],
        ["Через 399 дней 104 человек сообщили про озноб и сыпь.", "Смертей не было!"],
    ],
)
def test_units(model, units):
    text = " ".join(units) if not units[0][0] > "぀" else "".join(units)
    assert [text[a:b] for a, b in sentences(text, model)] == units
    wrapped = text.replace(" ", "\n") if "ไ" not in text else text
    assert [wrapped[a:b] for a, b in sentences(wrapped, model)] == [u.replace(" ", "\n") if "ไ" not in text else u for u in units]


def test_headings_labels_and_missing_spaces(model):
    text = "Methods\n\nBACKGROUND: In clinic A, samples were drawn.Imaging of the heart revealed cyst.\n \nMean urea fell"
    assert [text[a:b] for a, b in sentences(text, model)] == ["Methods", "BACKGROUND: In clinic A, samples were drawn.", "Imaging of the heart revealed cyst.", "Mean urea fell"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB1 .!?"“”()«»\n。„;ก ', max_size=80))
def test_spans_cover_all_but_white_space(text):
    spans = sentences(text, EMPTY)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert [b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)].count(False) == 0
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_rows(spark):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, " \n\n "), (5, "no mark"), (6, "long " * 200_000), (7, "A b. " * 20_000)]
    got = split_sentences(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start_pos"), "doc_id", "text").groupBy("doc_id").count()
    n = {r.doc_id: r["count"] for r in got.collect()}
    assert set(n) == {1, 5, 6, 7} and n[5] == n[6] == 1 and n[1] in (2, 4)
    assert split_sentences(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["她说：「今天不痛。昨天也不痛。睡得很好。食欲正常。」然后离开。", "随访已结束。"],
        ["患者写道（今天不痛。昨天也不痛。睡得很好。食欲正常）。", "随访已结束。"],
        ['One nurse wrote: "No pain today! Slept well! Ate well! Walked far!" in the chart.', "Was it gout?"],
        ["The list (Was it safe? Was it fast? Was it cheap? Was it new?) was long.", "Nobody answered!"],
    ],
)
def test_marks_with_many_sentences_are_not_divided(units):
    text = ("" if units[0][0] > "぀" else " ").join(units)
    assert [text[a:b] for a, b in sentences(text, EMPTY)] == units


def test_unit_of_many_undecided_candidates_is_whole():
    from termloom.llm.sentences import _select

    assert _select(0, 6000, [(10 * i, 10 * i + 1, -4.0) for i in range(1, 600)]) == [(0, 6000)]


def test_words_beyond_the_broadcast_count_alike(spark, monkeypatch):
    """With a handful of words sent to the executors all others come by a join, and the sentences stay the same."""
    from termloom.llm import sentences as S

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    whole = split_sentences(docs, "doc_id", "text").collect()
    monkeypatch.setattr(S, "MODEL_WORDS", 50)
    assert sorted(map(tuple, split_sentences(docs, "doc_id", "text").collect())) == sorted(map(tuple, whole))


def test_long_words_are_told_apart():
    from termloom.llm.sentences import _closing, _opening

    a, b = "x" * 50 + "a.", "x" * 50 + "b."
    assert _closing(a, len(a), 0) != _closing(b, len(b), 0) and _opening(a, 0) != _opening(b, 0)
    assert _closing("so " + "y" * 30 + ".", 34, 0) == "y" * 30 + "."
