import random

import numpy as np

from termloom.llm import leaks as L


def longest(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)


def test_longest_tile_is_the_longest_run():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(0, 40))] for _ in range(2))
        found = L.tiles(np.array(a, np.int64), np.array(b, np.int64), 4)
        n = longest(a, b)
        assert max((x[2] for x in found), default=0) == (n if n >= 4 else 0)
        for side in (0, 1):
            used = [p for x in found for p in range(x[side], x[side] + x[2])]
            assert len(used) == len(set(used))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)


def test_reordered_and_odd_rows(spark, monkeypatch):
    item = "Alpha beta gamma delta epsilon; zeta eta theta iota KAPPA lambda mu"
    swapped = "zeta-eta theta iota kappa LAMBDA mu and then alpha, beta gamma\ndelta epsilon"
    docs = spark.createDataFrame([(1, swapped, 0), (2, None, 0), (3, "", 0), (4, f"x {item} y", 0), (4, f"x {item} y", 0), (5, "alpha beta " * 50_000, 0)], "doc_id long, text string, longest int")
    items = spark.createDataFrame([("a", item), ("b", None), ("c", "one two"), ("d", item)], "item_id string, text string")
    for block in (1_000_000, 5):
        monkeypatch.setattr(L, "BLOCK_WORDS", block)
        got = sorted((r.doc_id, r.item_id, r.longest, r.covered, r.n_tiles) for r in L.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
        assert got == [(1, "a", 7, 12, 2), (1, "d", 7, 12, 2), *[(4, i, 12, 12, 1) for i in "aadd"]]
    assert L.find_leaks(docs.limit(0), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
