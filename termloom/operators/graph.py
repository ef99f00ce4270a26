"""Relations between concepts: best edges, both directions, two hops, grouped views, strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order in which kinds of relation are preferred, and names of the reverse of a relation.
RELATION_ORDER = ["RO", "PAR", "CHD", "RB", "RN", "SY", "RQ"]
INVERSE = {"isa": "inverse_isa", "inverse_isa": "isa", "part_of": "has_part", "cause_of": "due_to", "may_treat": "may_be_treated_by", "has_finding_site": "finding_site_of"}


def relation_place(relation: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, RELATION_ORDER)), F.upper(relation))
    return F.when(F.coalesce(place, F.lit(0)) == 0, 50).otherwise(place).cast("int")


def inverse_name(rela: Column, relation: Column) -> Column:
    """Name of a relation read backward: from the table, else the name marked as inverse."""
    name = F.when(F.coalesce(rela, F.lit("")) != "", rela).otherwise(F.coalesce(relation, F.lit("")))
    out = F.when(name == "", "inverse_related_to").otherwise(F.concat(F.lit("inverse_"), name))
    for forward, back in INVERSE.items():
        out = F.when(F.lower(name) == forward, back).otherwise(out)
    return out


def best_edges(edges: DataFrame, most: int) -> DataFrame:
    """The best edge of each pair (source_cui, target_cui) and of these the best ``most`` of each source, by kind of
    relation, name and target. Links of a concept to itself are left out; a source of any size is reduced by
    partial aggregation first."""
    order = F.struct(relation_place(F.col("relation")).alias("p"), F.coalesce("rela", F.lit("")).alias("rela"), "target_cui", "direction", "row_id")
    once = edges.where("source_cui <> target_cui").groupBy("source_cui", "target_cui").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("source_cui").orderBy("o"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("source_cui", "place", "target_cui", "o.rela", "o.direction", "o.row_id")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as it is and reversed, the reverse under its inverse name: source_cui, target_cui, name, way."""
    name = F.when(F.coalesce("rela", F.lit("")) != "", F.col("rela")).otherwise(F.coalesce("relation", F.lit("")))
    ways = F.array(
        F.struct(F.col("source_cui").alias("source_cui"), F.col("target_cui").alias("target_cui"), name.alias("name"), F.lit("outgoing").alias("way")),
        F.struct(F.col("target_cui").alias("source_cui"), F.col("source_cui").alias("target_cui"), inverse_name(F.col("rela"), F.col("relation")).alias("name"), F.lit("incoming").alias("way")),
    )
    return edges.where("source_cui <> target_cui").select("row_id", F.explode(ways).alias("w")).select("row_id", "w.*")


def two_hops(edges: DataFrame, most: int) -> DataFrame:
    """Concepts two links away over the ``most`` best edges of each concept, with the number of ways there; bounded
    by most squared a concept."""
    best = best_edges(edges, most)
    a = best.select(F.col("source_cui").alias("a"), F.col("target_cui").alias("b"))
    b = best.select(F.col("source_cui").alias("b"), F.col("target_cui").alias("c"))
    return a.join(b, "b").where("a <> c").groupBy("a", "c").agg(F.count("*").alias("ways"), F.min("b").alias("first_via"))


def grouped_view(edges: DataFrame, group: str, most: int) -> DataFrame:
    """The strongest ``most`` distinct targets of each source within each group of relations."""
    order = F.struct((-F.coalesce(F.nanvl("strength", F.lit(0.0)), F.lit(0.0))).alias("s"), "target_cui", "row_id")
    once = edges.groupBy("source_cui", group, "target_cui").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("source_cui", group).orderBy("o"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("source_cui", group, "place", "target_cui", (-F.col("o.s") + 0.0).alias("strength"))


def graph_score(edges: DataFrame, edge_cap: float, cap: float) -> DataFrame:
    """Evidence of each concept from its edges: every edge adds strength times confidence up to ``edge_cap``, all
    together at most ``cap``. Missing strength or confidence counts as 0."""
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    each = F.least(F.lit(edge_cap), known("strength") * known("confidence"))
    return edges.groupBy("source_cui").agg(F.count("*").alias("n_edges"), F.least(F.lit(cap), F.sum(each)).alias("score"))


def edge_strength(source_class: Column, support: Column, rank: Column) -> Column:
    """Strength of an edge by how it was found, its support (up to 10 counts) and its rank, between 0 and 1."""
    base = F.when(source_class == "curated_seed", 0.80).when(source_class == "review", 0.70).when(source_class == "ohdsi", 0.60).otherwise(0.45)
    value = base + 0.02 * F.least(F.coalesce(support, F.lit(0)), F.lit(10)) - 0.002 * F.least(F.coalesce(rank, F.lit(50)), F.lit(50))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
