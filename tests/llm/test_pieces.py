import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm.pieces import cuts, split_pieces

TOKEN = re.compile(r"[A-Za-z0-9]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c1 ", ". ", "\n", "\n\n", "é", "。", ", ", "x", " "]), max_size=400).map("".join), st.integers(4, 30), st.integers(0, 2))
def test_round_trip_limit_and_overlap(text, limit, overlap):
    pieces = cuts(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    assert all(len(TOKEN.findall(text[s:e])) <= limit for s, _, e in pieces)
    for (s, c, _), _before in zip(pieces[1:], pieces, strict=False):
        assert len(TOKEN.findall(text[s:c])) == overlap
    assert (len(pieces) > 1) == (len(TOKEN.findall(text)) > limit)


def test_cuts_at_sentence_ends():
    text = " ".join(f"Word{i} one two three four five six seven eight nine." for i in range(20))
    assert all(text[:c].endswith(". ") for _, c, _ in cuts(text, 60, 10)[1:])


def test_long_text_and_hard_cuts():
    text = "tok-" * 30_000
    pieces = cuts(text)
    assert "".join(text[c:e] for _, c, e in pieces) == text and max(e - s for s, _, e in pieces) <= 95 * 4


def test_rows(spark):
    rows = [(1, "s", "a " * 100, 9), (2, None, None, 9), (3, "s", "", 9), (1, "s", "a " * 100, 9)]
    df = spark.createDataFrame(rows, "row_id long, section string, text string, piece int")
    got = split_pieces(df, "row_id", "text", ["section"])
    assert got.groupBy("row_id").count().where("row_id = 3").first()["count"] == 1
    assert got.where("row_id = 1").count() == 4 and got.where("row_id = 2").count() == 0
    assert got.where("piece_text <> '' and section is null").count() == 0
    assert split_pieces(df.limit(0), "row_id", "text", ["section"]).count() == 0
    assert got.where(F.col("n_tokens") > 95).count() == 0
