"""Related concepts: buckets, unions of sources, whole bundles, roles over two links, canonical edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The buckets in their order, and the words of a relation's type or group that belong to each.
BUCKETS = {"treatments": ["treat", "indication", "therapy"], "causes": ["cause", "risk", "due_to"], "course": ["precede", "follow", "temporal"], "structure": ["part", "site", "isa"]}
# Kinds of relation by what their text holds, and the kinds that help a reader on.
KINDS = {"treats": ["treat", "indication"], "causes": ["cause", "due_to"], "is_a": ["isa"], "part_of": ["part"], "located_in": ["site", "located"]}
USEFUL = ["treats", "causes", "located_in"]


def bucket_of(kind: Column, group: Column) -> Column:
    """The first bucket whose words the type or group holds, else other."""
    said = F.lower(F.concat_ws(" ", kind, group))
    out = F.lit("other")
    for name, words in reversed(BUCKETS.items()):
        out = F.when(reduce(Column.__or__, (said.contains(w) for w in words)), name).otherwise(out)
    return out


def buckets(edges: DataFrame, strength: float, confidence: float, most: int) -> DataFrame:
    """(source_cui, bucket, place, target_cui, strength): targets of edges strong and sure enough, each in one bucket,
    the strongest ``most`` of a bucket. Partial aggregation first, so a concept of any size is no burden."""
    strong = edges.where((F.nanvl("strength", F.lit(None)) >= strength) & (F.nanvl("confidence", F.lit(None)) >= confidence) & (F.col("source_cui") != F.col("target_cui")))
    order = F.struct((-F.col("strength")).alias("s"), "target_cui", "row_id")
    once = strong.withColumn("bucket", bucket_of(F.col("relationship_type"), F.col("relation_group"))).groupBy("source_cui", "bucket", "target_cui").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("source_cui", "bucket").orderBy("o"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("source_cui", "bucket", "place", "target_cui", (-F.col("o.s")).alias("strength"))


def first_wins(sources: list[DataFrame], most: int) -> DataFrame:
    """(source_cui, place, target_cui, origin): targets of several relation tables (source_cui, target_cui, row_id), a
    target from the first table that has it, in the order of tables and rows, ``most`` a concept."""
    every = reduce(DataFrame.unionByName, (d.where("source_cui is not null and target_cui is not null").withColumn("origin", F.lit(i)) for i, d in enumerate(sources, 1)))
    once = every.groupBy("source_cui", "target_cui").agg(F.min(F.struct("origin", "row_id")).alias("o"))
    place = F.row_number().over(Window.partitionBy("source_cui").orderBy("o", "target_cui"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("source_cui", "place", "target_cui", "o.origin")


def bundle(labels: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a concept of the labels: label, n_names, n_evidence, n_out, n_in and the strongest target."""
    lab = labels.where("cui is not null").groupBy("cui").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n_names"))
    ev = evidence.groupBy("cui").agg(F.count("*").alias("n_evidence"))
    out = edges.groupBy(F.col("source_cui").alias("cui")).agg(F.count("*").alias("n_out"), F.min(F.when(~F.isnan("strength") & F.col("strength").isNotNull(), F.struct((-F.col("strength")).alias("s"), "target_cui"))).alias("o"))
    into = edges.groupBy(F.col("target_cui").alias("cui")).agg(F.count("*").alias("n_in"))
    whole = lab.join(ev, "cui", "left").join(out, "cui", "left").join(into, "cui", "left")
    return whole.select("cui", "label", "n_names", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_evidence", "n_out", "n_in")), F.col("o.target_cui").alias("strongest"))


def roles(edges: DataFrame) -> DataFrame:
    """(first, second, role, pairs): kinds of two links in a row, what the far end is by them, and how many distinct
    pairs of ends there are. Links of a pair count once a kind before they are joined."""
    kind = kind_of(F.col("relationship_type"))
    e = edges.where("source_cui <> target_cui").select("source_cui", "target_cui", kind.alias("kind")).distinct()
    two = e.select(F.col("source_cui").alias("a"), F.col("target_cui").alias("b"), F.col("kind").alias("first")).join(e.select(F.col("source_cui").alias("b"), F.col("target_cui").alias("c"), F.col("kind").alias("second")), "b").where("a <> c")
    role = F.when((F.col("first") == "treats") & (F.col("second") == "treats"), "same use").when(F.col("first") == F.col("second"), "chain").when(F.col("second") == "treats", "use").otherwise("other")
    return two.select("first", "second", role.alias("role"), "a", "c").distinct().groupBy("first", "second", "role").agg(F.count("*").alias("pairs"))


def kind_of(text: Column) -> Column:
    said = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("associated_with")
    for name, words in reversed(KINDS.items()):
        out = F.when(reduce(Column.__or__, (said.contains(w) for w in words)), name).otherwise(out)
    return out


def canonical(relations: DataFrame) -> DataFrame:
    """relations with ``edge``: subject and object in the direction of the statement, kind, and whether the kind is a
    useful one. What comes in, or is named an inverse, is turned round."""
    said = F.coalesce(F.nullif("rela", F.lit("")), "relation")
    back = (F.coalesce(F.col("direction"), F.lit("")) == "incoming") != F.coalesce(F.lower(said).startswith("inverse"), F.lit(False))
    kind = kind_of(said)
    return relations.withColumn("edge", F.struct(F.when(back, F.col("target_cui")).otherwise(F.col("source_cui")).alias("subject"), F.when(back, F.col("source_cui")).otherwise(F.col("target_cui")).alias("object"), kind.alias("kind"), kind.isin(USEFUL).alias("useful")))


def _case(said: str, table: dict[str, list[str]], default: str) -> str:
    return "case " + " ".join(f"when {' or '.join(f"contains({said}, '{w}')" for w in words)} then '{name}'" for name, words in table.items()) + f" else '{default}' end"


_KIND = _case("lower(coalesce(relationship_type, ''))", KINDS, "associated_with")
_SAID = "lower(coalesce(nullif(rela, ''), relation, ''))"
_BACK = f"(coalesce(direction, '') = 'incoming') <> starts_with({_SAID}, 'inverse')"
SQL = {
    "related_buckets": f"""with o as (select source_cui, {_case("lower(concat_ws(' ', relationship_type, relation_group))", BUCKETS, "other")} as bucket, target_cui, max(strength) as strength from relationship_edges
where strength >= 0.58 and not isnan(strength) and confidence >= 0.50 and not isnan(confidence) and source_cui <> target_cui group by all)
select source_cui, bucket, cast(row_number() over (partition by source_cui, bucket order by strength desc, target_cui) as integer) as place, target_cui, strength from o qualify place <= 6""",
    "related_union": """with u as (select source_cui, target_cui, 1 as origin, row_id from relationship_edges where source_class = 'curated_seed' union all select source_cui, target_cui, 2, row_id from related_concepts),
o as (select source_cui, target_cui, min(struct_pack(origin := origin, row_id := row_id)) as o from u where source_cui is not null and target_cui is not null group by all)
select source_cui, cast(row_number() over (partition by source_cui order by o.origin, o.row_id, target_cui) as integer) as place, target_cui, o.origin from o qualify place <= 5""",
    "related_bundle": """with l as (select cui, min(label) as label, count(distinct label) as n_names from labels where cui is not null group by 1), e as (select cui, count(*) as n_evidence from evidence group by 1),
o as (select source_cui as cui, count(*) as n_out from relationship_edges group by 1), s as (select source_cui as cui, target_cui as strongest from relationship_edges where strength is not null and not isnan(strength) and target_cui is not null qualify row_number() over (partition by source_cui order by strength desc, target_cui) = 1), i as (select target_cui as cui, count(*) as n_in from relationship_edges group by 1)
select l.*, coalesce(n_evidence, 0) as n_evidence, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, strongest from l left join e using (cui) left join o using (cui) left join s using (cui) left join i using (cui)""",
    "related_roles": f"""with e as (select distinct source_cui, target_cui, {_KIND} as kind from relationship_edges where source_class in ('curated_seed', 'review') and source_cui <> target_cui),
t as (select distinct a.kind as first, b.kind as second, a.source_cui as a, b.target_cui as c from e a join e b on a.target_cui = b.source_cui where a.source_cui <> b.target_cui)
select first, second, case when first = 'treats' and second = 'treats' then 'same use' when first = second then 'chain' when second = 'treats' then 'use' else 'other' end as role, count(*) as pairs from t group by all""",
    "edge_structs": f"""select row_id, case when {_BACK} then target_cui else source_cui end as subject, case when {_BACK} then source_cui else target_cui end as object, {_case(_SAID, KINDS, "associated_with")} as kind, {_case(_SAID, KINDS, "associated_with")} in ('treats', 'causes', 'located_in') as useful from related_concepts""",
}
