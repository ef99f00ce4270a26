"""Parent-child links to whole hierarchies: path, depth, root, descendants and cycles.

Terms may have several parents, so the links form a graph, not a tree. One parent of each term (its smallest)
makes a spanning forest. Over the forest, subtree sizes are summed upward and preorder ranges handed out downward
by prefix sums over siblings, both by pointer doubling: a forest of depth d takes about log2(d) rounds, where one
round a level would take d. A term is then an ancestor of another exactly if its range encloses the other's.
Terms that no doubling round brings to a root sit on or below a loop of first parents; one link of each such loop
is set aside. All links outside the forest ("side links") are few: whatever leads over them is solved on the
graph of their ends and carried back to the terms through the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.cumulative import running_total
from termloom.session import cut, cut_counting

#: Width of the slices of the preorder axis on which enclosing ranges are looked up.
SLICE = 1024


def parent_links(terms: DataFrame, term: str = "term_id", parents: str = "parents") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a table with one or more rows a term and a list of parents written unevenly.

    A parent entry means the identifier it begins with (letters, colon or underscore, digits), compared in upper
    case with a colon; entries that are null, empty or without a term are void; repeated ones count once. Terms
    are compared the same way, and rows whose term is null or without an identifier are left out.
    """
    head = r"^\s*([A-Za-z]+)[:_]([0-9]+)"
    ident = lambda c: F.when(c.rlike(head), F.upper(F.concat(F.regexp_extract(c, head, 1), F.lit(":"), F.regexp_extract(c, head, 2))))
    named = terms.select(ident(F.col(f"`{term}`")).alias("node"), F.col(f"`{parents}`").alias("ps")).where("node is not null")
    nodes = cut(named.select("node").distinct())
    raw = named.select("node", F.explode("ps").alias("p")).select("node", ident(F.col("p")).alias("parent")).where("parent is not null").distinct()
    return nodes, cut(raw.join(nodes.select(F.col("node").alias("parent")), "parent").select("node", "parent"))


@dataclass
class Hierarchy:
    """forest: node, root, depth, lft, rgt (descendants are the nodes with
    lft < their lft < rgt), is_root (the root has no parents at all). hubs: the terms with side links, with their
    ranges. ends: node, parent and the parent's place, of each side link. hops: from hub to hub over a side link.
    reach: node, root, depth, the fewest links to each root. cyclic: node, of every term that is its own ancestor.
    links: node, parent. What a query does not ask for is not solved."""

    forest: DataFrame
    hubs: DataFrame
    ends: DataFrame
    hops: DataFrame
    links: DataFrame

    @cached_property
    def reach(self) -> DataFrame:
        known = self.forest.select("node", "lft", "depth", "root", "is_root")
        start = self.ends.where("end_real").groupBy("node", F.col("end_root").alias("root")).agg((1 + F.min("end_depth")).alias("depth"))
        best = _shortest(cut(start), self.hops)
        over = _enclosing(known.select("node", F.col("lft").alias("at"), F.col("depth").alias("own")), self.hubs).select("node", "hub", (F.col("own") - F.col("hub_depth")).alias("up"))
        via = over.join(best.select(F.col("node").alias("hub"), "root", F.col("depth").alias("rest")), "hub").select("node", "root", (F.col("up") + F.col("rest")).alias("depth"))
        return cut(known.where("is_root").select("node", "root", "depth").unionByName(via).groupBy("node", "root").agg(F.min("depth").cast("int").alias("depth")))

    @cached_property
    def cyclic(self) -> DataFrame:
        return cut(_on_cycles(self.forest, self.hops))


def hierarchy(nodes: DataFrame, links: DataFrame) -> Hierarchy:
    """Solve the links (node, parent) between ``nodes`` (node). Empty tables give empty results."""
    first = links.groupBy("node").agg(F.min("parent").alias("parent"))
    tree, sized = _forest(nodes, first)
    forest = _nested_sets(tree, sized)
    side = cut(links.join(tree.select("node", F.col("parent").alias("kept")), "node").where(~F.col("kept").eqNullSafe(F.col("parent"))).select("node", "parent"))
    known = forest.select("node", "lft", "rgt", "depth", "root", "is_root")
    hubs = side.select("node").distinct().join(known, "node")
    ends = side.join(known.select(F.col("node").alias("parent"), F.col("lft").alias("at"), F.col("depth").alias("end_depth"), F.col("root").alias("end_root"), F.col("is_root").alias("end_real")), "parent")
    # hub -> hub: over a side link, then up the forest to a term that has a side link itself
    hops = cut(_enclosing(ends.select("node", "parent", "at", "end_depth"), hubs).select(F.col("node").alias("src"), F.col("hub").alias("dst"), "parent", F.col("hub_depth").alias("dst_depth"), (1 + F.col("end_depth") - F.col("hub_depth")).alias("w")))
    return Hierarchy(forest, hubs, ends, hops, links)


def descendants(h: Hierarchy) -> DataFrame:
    """(node, descendant, distance) over all links: every pair of a term and another one below it, once, with the
    fewest links between them.

    Along the forest the ranges tell. Any other way climbs from the descendant to a hub, goes on from hub to hub
    and at last over a side link and up the forest to the ancestor.
    """
    points = h.forest.select("node", F.col("lft").alias("at"), F.col("depth").alias("own"))
    along = _enclosing(points, h.forest).select(F.col("hub").alias("above"), "node", (F.col("own") - F.col("hub_depth")).alias("distance"))
    last = _enclosing(h.ends.select("node", "at", "end_depth"), h.forest).groupBy("node", F.col("hub").alias("root")).agg(F.min(1 + F.col("end_depth") - F.col("hub_depth")).alias("depth"))
    best = _shortest(cut(last), h.hops).select(F.col("node").alias("hub"), F.col("root").alias("above"), F.col("depth").alias("rest"))
    over = _enclosing(points, h.hubs).select("node", "hub", (F.col("own") - F.col("hub_depth")).alias("up"))
    via = over.join(best, "hub").select("above", "node", (F.col("up") + F.col("rest")).alias("distance"))
    pairs = along.unionByName(via).where("above <> node").groupBy("above", "node").agg(F.min("distance").cast("int").alias("distance"))
    return pairs.select(F.col("above").alias("node"), F.col("node").alias("descendant"), "distance")


def _climb(tree: DataFrame) -> tuple[DataFrame, int]:
    """Each node of ``tree`` (node, parent or null) with the number of nodes below and including it, its depth and its
    topmost ancestor (top), by doubling; and how many nodes lead into loops. Of these ``far`` is set and the rest
    means nothing; they add nothing to the others, for all their ancestors lead into loops as well.

    After k rounds sizes count what is less than 2^k below. Depths leave no gaps, so a round in which nobody arrives
    at a root is the last.
    """
    state = cut(tree.select("node", F.col("parent").alias("far"), F.coalesce("parent", "node").alias("top"), F.lit(1).cast("long").alias("size"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    before = None
    while True:
        gain = state.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("size").alias("gain"))
        ahead = state.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("top").alias("up"), F.col("depth").alias("more"))
        state, left = cut_counting(
            state.join(ahead, "far", "left").join(gain, "node", "left").select(
                "node",
                F.col("next").alias("far"),
                F.coalesce("up", "top").alias("top"),
                (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            F.col("far").isNotNull(),
        )
        if left in (0, before):
            return state, left
        before = left


def _loop_heads(jump: DataFrame, first: DataFrame) -> DataFrame:
    """The smallest term of each loop that the first parents form; ``jump`` (node, far) leads far ahead from each node
    that never arrives at a root."""
    # images under ever longer jumps shrink to the loops themselves
    size = None
    while True:
        image = jump.select("far").distinct()
        if size == (now := image.count()):
            break
        size = now
        jump = cut(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("next")), "far").select("node", F.col("next").alias("far")))
    ring = image.select(F.col("far").alias("node"))
    walk = cut(first.join(ring, "node").select("node", F.col("parent").alias("far"), F.col("node").alias("low")))
    while True:
        ahead = walk.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("low").alias("low2"))
        longer = walk.join(ahead, "far").select("node", F.col("next").alias("far"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed"))
        longer, changed = cut_counting(longer, F.col("changed"))
        walk = longer.drop("changed")
        if not changed:
            return walk.select(F.col("low").alias("node")).distinct()


def _forest(nodes: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, sized): each node with its first parent, save one link of each loop (is_root says that it has none at
    all); and each node's size, depth and top in that forest."""
    tree = cut(nodes.join(first, "node", "left").select("node", "parent", F.col("parent").isNull().alias("is_root")))
    state, left = _climb(tree)
    if not left:
        return tree, state
    lost = cut(state.where("far is not null").select("node", "far"))
    heads = _loop_heads(lost, first).withColumn("head", F.lit(True))
    tree = cut(tree.join(heads, "node", "left").select("node", F.when(F.col("head").isNull(), F.col("parent")).alias("parent"), "is_root"))
    rest, _ = _climb(tree.join(lost.select("node"), "node", "left_semi"))
    return tree, state.where("far is null").unionByName(rest)


def _nested_sets(tree: DataFrame, sized: DataFrame) -> DataFrame:
    """lft, rgt, depth and root of each node of a forest, from the sizes: a node starts behind its parent and its
    earlier siblings."""
    sized = sized.join(tree, "node").select("node", "parent", "is_root", "size", "depth", "top")
    ordered = cut(running_total(sized.withColumn("family", F.coalesce("parent", F.lit(""))), ["family", "node"], F.col("size"), "total"))
    eldest = ordered.groupBy("family").agg(F.min("total").alias("eldest"))
    ordered = ordered.join(eldest, "family").withColumn("offset", F.col("total") - F.col("eldest") + F.when(F.col("parent").isNull(), 0).otherwise(1))
    walk, left = cut_counting(ordered.select("node", F.col("parent").alias("far"), F.col("offset").alias("lft")), F.col("far").isNotNull())
    while left:
        ahead = walk.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("lft").alias("more"))
        longer = walk.join(ahead, "far", "left").select("node", F.col("next").alias("far"), (F.col("lft") + F.coalesce("more", F.lit(0))).alias("lft"))
        walk, left = cut_counting(longer, F.col("far").isNotNull())
    real = tree.where("parent is null").select(F.col("node").alias("top"), F.col("is_root").alias("real"))
    whole = ordered.join(walk.select("node", "lft"), "node").join(real, "top")
    return cut(whole.select("node", F.col("top").alias("root"), "depth", "lft", (F.col("lft") + F.col("size")).alias("rgt"), F.col("real").alias("is_root")))


def _enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point (at, ...) with every range (node, lft, rgt, depth) around it, as hub and hub_depth.

    Preorder numbers are dense, so slices of equal width hold equally many nodes whatever the shape of the
    hierarchy, and a range is copied once a slice it touches, not once a node.
    """
    sliced = ranges.select(F.col("node").alias("hub"), "lft", "rgt", F.col("depth").alias("hub_depth"))
    sliced = sliced.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lft") / SLICE), F.floor((F.col("rgt") - 1) / SLICE))))
    joined = points.withColumn("slice", F.floor(F.col("at") / SLICE)).join(sliced, "slice")
    return joined.where("lft <= at and at < rgt").drop("slice", "lft", "rgt")


def _shortest(start: DataFrame, hops: DataFrame) -> DataFrame:
    """Fewest links from each hub to each root (or other term) it leads to, relaxed from the last improvements only."""
    best = fresh = start
    back = cut(hops.groupBy("src", "dst").agg(F.min("w").alias("w")))
    left = 1
    while left:
        found = fresh.withColumnRenamed("node", "dst").join(back, "dst").groupBy(F.col("src").alias("node"), "root").agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        fresh, left = cut_counting(found.join(best.withColumnRenamed("depth", "old"), ["node", "root"], "left").where("old is null or depth < old").select("node", "root", "depth"), F.lit(True))
        best = cut(best.unionByName(fresh).groupBy("node", "root").agg(F.min("depth").alias("depth"))) if left else best
    return best


def _on_cycles(forest: DataFrame, hops: DataFrame) -> DataFrame:
    """Terms on a cycle: those on the way of a hop between two hubs that reach each other."""
    left, size = cut_counting(hops.select("src", "dst").distinct(), F.lit(True))
    inner: list[DataFrame] = []  # hops inside a strongly connected set of hubs
    while size:
        while True:  # hubs without a hop in or out are on no cycle
            both = left.select(F.col("src").alias("h")).intersect(left.select(F.col("dst").alias("h")))
            left, now = cut_counting(left.join(both.withColumnRenamed("h", "src"), "src").join(both.withColumnRenamed("h", "dst"), "dst"), F.lit(True))
            if now in (0, size):
                break
            size = now
        if not now:
            break
        # each hub takes the largest hub that leads to it; where a hub keeps its own, its set is closed backward
        colour, moved = cut(left.select(F.explode(F.array("src", "dst")).alias("h")).distinct().withColumn("c", F.col("h"))), 1
        while moved:
            pushed = left.join(colour, left.src == colour.h).groupBy(F.col("dst").alias("h")).agg(F.max("c").alias("pc"))
            step = colour.join(pushed, "h", "left").select("h", F.greatest("c", F.coalesce("pc", "c")).alias("c"), (F.col("pc") > F.col("c")).alias("moved"))
            step, moved = cut_counting(step, F.col("moved"))
            colour = step.select("h", "c")
        cs = colour.withColumnRenamed("h", "src").withColumnRenamed("c", "cs")
        cd = colour.withColumnRenamed("h", "dst").withColumnRenamed("c", "cd")
        same = cut(left.join(cs, "src").join(cd, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        member = fresh = cut(colour.where("h = c"))
        while True:
            more = same.join(fresh.select(F.col("h").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("h"), "c").distinct().join(member, ["h", "c"], "left_anti")
            fresh, found = cut_counting(more, F.lit(True))
            if not found:
                break
            member = cut(member.unionByName(fresh))
        strong = same.join(member.select(F.col("h").alias("src"), "c"), ["src", "c"]).join(member.select(F.col("h").alias("dst"), "c"), ["dst", "c"])
        inner.append(cut(strong.select("src", "dst")))
        left, size = cut_counting(left.join(member.select(F.col("h").alias("src")), "src", "left_anti").join(member.select(F.col("h").alias("dst")), "dst", "left_anti"), F.lit(True))
    if not inner:
        return forest.select("node").limit(0)
    ways = hops.join(reduce(DataFrame.unionByName, inner).distinct(), ["src", "dst"]).groupBy("parent").agg(F.min("dst_depth").alias("top"))
    points = ways.join(forest.select(F.col("node").alias("parent"), F.col("lft").alias("at")), "parent")
    return _enclosing(points, forest).where("hub_depth >= top").select(F.col("hub").alias("node")).distinct()


def shortest_paths(h: Hierarchy) -> DataFrame:
    """(node, root, depth, path): for each term and each root it leads up to a way of fewest links, the root first and
    the term last; of several the one over the smallest parents, from the term upward. Doubling over the pairs."""
    above = h.reach.select(F.col("node").alias("parent"), "root", (F.col("depth") + 1).alias("depth"))
    onward = h.links.join(above, "parent").join(h.reach, ["node", "root", "depth"]).groupBy("node", "root").agg(F.min("parent").alias("far"))
    state, left = cut_counting(h.reach.join(onward, ["node", "root"], "left").select("node", "root", "depth", "far", F.array("node").alias("path")), F.col("far").isNotNull())
    while left:
        ahead = state.select(F.col("node").alias("far"), "root", F.col("far").alias("next"), F.col("path").alias("front"))
        longer = state.join(ahead, ["far", "root"], "left").select("node", "root", "depth", F.col("next").alias("far"), F.when(F.col("front").isNull(), F.col("path")).otherwise(F.concat("front", "path")).alias("path"))
        state, left = cut_counting(longer, F.col("far").isNotNull())
    return state.select("node", "root", "depth", "path")
