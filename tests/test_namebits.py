import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.functions import text as T
from termloom.operators import link as L
from termloom.operators import namebits as N


def brute(texts, names, most):
    """Runs by hand, from texts already normalised."""
    out = []
    for doc, text in texts:
        t = (text or "").split()
        for i in range(len(t)):
            for n in range(1, min(most, len(t) - i) + 1):
                run = t[i : i + n]
                if run[0] not in T.STOPWORDS and run[-1] not in T.STOPWORDS and " ".join(run) in names:
                    out.append((doc, i + 1, n, " ".join(run), names[" ".join(run)]))
    return sorted(out)


def test_only_runs_that_may_be_names_leave_the_texts(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["of", "the"]
    texts = [(d, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for d in range(300)] + [(900, None), (901, "")]
    keys = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(400)}
    names = {k: f"C{i}" for i, k in enumerate(sorted(keys))}
    docs = spark.createDataFrame(texts, "doc long, text string")
    held = spark.createDataFrame([(k, c, len(k.split())) for k, c in names.items()], "key string, cui string, n_tokens int")
    want = brute(texts, names, 3)
    assert want and sorted(map(tuple, L.candidates(docs, held, 3).collect())) == want
    # before, all runs were spelled out and shuffled; now hardly more than the names among them
    assert len(want) <= N.possible(docs, held, 3).count() <= 1.05 * len(want) + 5
    s = L.spans(spark.createDataFrame([(7, "The w1 of w2"), (8, "W2!")], "doc long, text string"), spark.createDataFrame([("w2", "C", 1)], "key string, cui string, n_tokens int"), 3)
    assert {(r.doc, r.start, r.size, r.content) for r in s.collect()} == {(7, 4, 4, 2), (8, 1, 1, 1)}


def test_long_texts_in_portions_and_no_names(spark, monkeypatch):
    monkeypatch.setattr(N, "PORTION", 50)
    docs = spark.createDataFrame([(f"d{i}", "knee pain and " * 30) for i in range(5)], "doc string, text string")
    names = spark.createDataFrame([("knee pain", "C1", 2)], "key string, cui string, n_tokens int")
    assert L.candidates(docs, names, 8).count() == 150
    assert L.candidates(docs, names.limit(0), 8).count() == 0


def test_filter_misses_no_name_however_crowded(monkeypatch):
    monkeypatch.setattr(N, "MOST_BITS", N.LEAST_BITS)
    h = N.name_hashes(pa.array([f"name {i} of" for i in range(5000)]))
    assert len(np.unique(h)) == 5000
    segment, places = N._places(h)
    bits = np.zeros(N.SEGMENTS * N.LEAST_BITS, bool)
    for at in places:
        bits[segment * N.LEAST_BITS + (at & (N.LEAST_BITS - 1))] = True
    first = np.arange(N.SEGMENTS) * (N.LEAST_BITS // 8)
    assert len(N.may_be_name(h, np.packbits(bits, bitorder="little"), first, np.full(N.SEGMENTS, N.LEAST_BITS - 1))) == 5000


@pytest.mark.parametrize("name", ["mentions_maximal", "link_evidence", "resolve_text", "mentions_scored"])
def test_texts_are_not_spelled_out_nor_joined_again(spark, small, name):
    """Runs come from the filter; in the plan, texts are read once for them and for no later join."""
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan and plan.count("text#") > 0
    assert sum("Project [row_id#" in line and "translate(text#" in line for line in plan.splitlines()) <= 1 and df.count() >= 0
