import random

import pytest
from pyspark.sql import functions as F

from termloom.operators.hierarchy import descendants, hierarchy, parent_links, shortest_paths


def brute(par):
    up = {}
    for t in par:
        d, fr = {t: 0}, [t]
        while fr:
            fr2 = []
            for x in fr:
                for p in par[x]:
                    if p not in d:
                        d[p] = d[x] + 1
                        fr2.append(p)
            fr = fr2
        up[t] = d
    reach = {(t, r, d) for t in par for r, d in up[t].items() if not par[r]}
    cyc = {t for t in par if any(t in up[p] for p in par[t])}
    return reach, cyc


def solve(spark, par):
    rows = [(t, list(ps)) for t, ps in par.items()]
    h = hierarchy(*parent_links(spark.createDataFrame(rows, "term_id string, parents array<string>")))
    return h, {(r.node, r.root, r.depth) for r in h.reach.collect()}, {r.node for r in h.cyclic.collect()}


@pytest.mark.parametrize("seed,n,back", [(1, 60, 3), (2, 120, 8), (3, 40, 12)])
def test_random_graphs(spark, seed, n, back):
    rnd = random.Random(seed)
    name = lambda i: f"T:{i:04d}"
    par = {name(i): {name(rnd.randrange(max(0, i - 6), i)) for _ in range(rnd.choice([1, 1, 1, 2]))} if i > 2 else set() for i in range(n)}
    for _ in range(back):
        a, b = rnd.randrange(n), rnd.randrange(n)
        par[name(min(a, b))].add(name(max(a, b)))
    h, reach, cyc = solve(spark, par)
    assert (reach, cyc) == brute(par)
    assert h.forest.count() == n
    starts = sorted(r.lft for r in h.forest.collect())
    by_root = h.forest.groupBy("root").count().collect()
    assert len(starts) == n == sum(r["count"] for r in by_root)


def test_chain_ranges_and_paths(spark):
    par = {f"C:{i}": ({f"C:{i - 1}"} if i else set()) for i in range(30)}
    h, reach, cyc = solve(spark, par)
    assert ("C:29", "C:0", 29) in reach and not cyc
    got = h.forest.where("node = 'C:29'").first()
    way = shortest_paths(h).where("node = 'C:29'").first()
    assert way.path == [f"C:{i}" for i in range(30)] and got.rgt - got.lft == 1
    assert descendants(h).where("node = 'C:10'").count() == 19


def test_uneven_entries_and_empty(spark):
    rows = [("X:1", None), ("X:1", []), ("x_2", [" x_1 ", "X:1 ! first", None, "", "Y:9", "nothing"]), ("X:3", ["X:3"]), (None, ["X:1"]), ("X:4", ["X:3", "X:2"])]
    df = spark.createDataFrame(rows, "term_id string, parents array<string>").withColumn("node", F.lit("clash")).withColumn("depth", F.lit(7))
    h = hierarchy(*parent_links(df))
    assert {tuple(r) for r in h.reach.collect()} == {("X:1", "X:1", 0), ("X:2", "X:1", 1), ("X:4", "X:1", 2)}
    assert [r.node for r in h.cyclic.collect()] == ["X:3"]
    none = hierarchy(*parent_links(df.limit(0)))
    assert none.reach.count() == none.cyclic.count() == none.forest.count() == descendants(none).count() == 0


def below(par):
    """{(ancestor, descendant): fewest links} over all links, by search from every term."""
    out = {}
    for t in par:
        d, fr = {t: 0}, [t]
        for x in fr:
            for p in par[x]:
                if p not in d:
                    d[p] = d[x] + 1
                    fr.append(p)
        out |= {(a, t): n for a, n in d.items() if a != t}
    return out


@pytest.mark.parametrize("seed,n,back", [(4, 90, 0), (5, 70, 6)])
def test_descendants_over_all_links(spark, seed, n, back):
    rnd = random.Random(seed)
    name = lambda i: f"T:{i:04d}"
    par = {name(i): {name(rnd.randrange(max(0, i - 9), i)) for _ in range(rnd.choice([1, 1, 2, 3]))} if i > 2 else set() for i in range(n)}
    for _ in range(back):
        a, b = sorted(rnd.sample(range(n), 2))
        par[name(a)].add(name(b))
    h = hierarchy(*parent_links(spark.createDataFrame([(t, list(ps)) for t, ps in par.items()], "term_id string, parents array<string>")))
    got = descendants(h).collect()
    want = below(par)
    assert len(got) == len(want) and {(r.node, r.descendant): r.distance for r in got} == want


def test_path_rows_count_descendants_over_second_parents(spark, tmp_path):
    from termloom.plans.preparation import p7_paths

    rows = [("D:1", []), ("D:2", ["D:1"]), ("D:3", ["D:1"]), ("D:4", ["D:2", "D:3"]), ("D:5", ["D:4"])]
    spark.createDataFrame(rows, "term_id string, parents array<string>").write.parquet(f"{tmp_path}/obo_terms.parquet")
    assert {r.term_id: r.n_descendants for r in p7_paths(spark, str(tmp_path)).collect()} == {"D:1": 4, "D:2": 2, "D:3": 2, "D:4": 1, "D:5": 0}


def test_paths_to_every_root_and_around_loops(spark):
    par = {"R:1": set(), "R:2": set(), "A:1": {"R:1"}, "A:2": {"R:2", "A:1"}, "L:1": {"L:2", "A:2"}, "L:2": {"L:1"}, "Z:1": {"Z:2"}, "Z:2": {"Z:1"}}
    h, reach, cyc = solve(spark, par)
    assert (reach, cyc) == brute(par)
    got = {(r.node, r.root): r.path for r in shortest_paths(h).collect()}
    assert len(got) == len(reach) and got["L:2", "R:1"] == ["R:1", "A:1", "A:2", "L:1", "L:2"] and got["L:2", "R:2"] == ["R:2", "A:2", "L:1", "L:2"]
    assert all(b in par and a in par[b] for p in got.values() for a, b in zip(p, p[1:], strict=False))
