"""Queries over packed fields (p4) and hierarchies (p7), with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.hierarchy import descendants, hierarchy, parent_links, shortest_paths
from termloom.operators.packed import unpack
from termloom.session import table

PACKED = ["expected_cuis", "disallowed_cuis", "context_cuis"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)


def _solved(spark: SparkSession, sf_dir: str):
    return hierarchy(*parent_links(table(spark, sf_dir, "obo_terms", "term_id", "parents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _solved(spark, sf_dir)
    cyc = h.cyclic.select(F.col("node").alias("term_id"), F.lit("cycle").alias("root_id"), F.lit(-1).alias("depth"))
    return h.reach.select(F.col("node").alias("term_id"), F.col("root").alias("root_id"), "depth").unionByName(cyc)


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term with each root it leads up to: depth, path of fewest links, and the term's number of descendants, all
    over all parents. A term without any root, which only loops lead up from, has one row without root and path."""
    h = _solved(spark, sf_dir)
    below = descendants(h).groupBy("node").agg(F.count("*").alias("n"))
    paths = h.forest.select("node").join(shortest_paths(h), "node", "left").join(below, "node", "left")
    return paths.select(F.col("node").alias("term_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), F.coalesce("n", F.lit(0)).alias("n_descendants"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_solved(spark, sf_dir)).select(F.col("node").alias("term_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {"p4_found": p4_found, "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants}

_P4_FIELD = r"""
select row_id, '{f}' as field, case when regexp_full_match(trim({f}, e' \t\r\n'), '\[(?s:.*)\]') then substr(trim({f}, e' \t\r\n'), 2, length(trim({f}, e' \t\r\n')) - 2) else {f} end as t
from search_quality_patient_portal_queries where {f} is not null"""

_LINKS = r"""
ent as (select upper(replace(regexp_extract(term_id, '^\s*([A-Za-z]+[:_][0-9]+)', 1), '_', ':')) as node, unnest(case when len(parents) = 0 or parents is null then [null] else parents end) as p from obo_terms),
nodes as (select distinct node from ent where node <> ''),
links as (select distinct e.node, n.node as parent from ent e join nodes n on n.node = upper(replace(regexp_extract(e.p, '^\s*([A-Za-z]+[:_][0-9]+)', 1), '_', ':')) where e.node <> '')"""

# fewest links are fewer than there are terms
_UP = f"""with recursive {_LINKS},
up as (select node, node as anc, 0 as depth from nodes union select u.node, l.parent, u.depth + 1 from up u join links l on l.node = u.anc where u.depth < (select count(*) from nodes)),
reach as (select node, anc as root, min(depth) as depth from up where anc not in (select node from links) group by all)"""

SQL = {
    "p4_found": "with f as ("
    + " union all ".join(_P4_FIELD.format(f=f) for f in PACKED)
    + r"""),
pieces as (select row_id, field, unnest(regexp_extract_all(t, '(?:"(?:[^"]|"")*"|\([^()]*\)|[^;,|\t\r\n"(]|["(])+')) as piece, generate_subscripts(regexp_extract_all(t, '(?:"(?:[^"]|"")*"|\([^()]*\)|[^;,|\t\r\n"(]|["(])+'), 1) as i from f),
cleaned as (select row_id, field, i, trim(piece) as v from pieces where trim(piece) <> ''),
parts as (select row_id, field, i, case when regexp_full_match(v, '[A-Za-z]+[:_]?[0-9]+(?: +[A-Za-z]+[:_]?[0-9]+)+') then regexp_split_to_array(v, ' +') else [v] end as vs from cleaned),
one as (select row_id, field, i, generate_subscripts(vs, 1) as j, unnest(vs) as v from parts),
bare as (select row_id, field, i, j, case when regexp_full_match(v, '"(?:[^"]|"")*"') then trim(replace(substr(v, 2, length(v) - 2), '""', '"')) else v end as val from one)
select row_id, field, cast(row_number() over (partition by row_id, field order by i, j) as integer) as pos, val from bare where val <> ''""",
    "p7_found": f"""{_UP},
anc as (select node, parent as anc from links union select a.node, l.parent from anc a join links l on l.node = a.anc)
select node as term_id, root as root_id, depth from reach union all select distinct node, 'cycle', -1 from anc where node = anc""",
    "p7_descendants": f"""{_UP} select anc as term_id, node as descendant_id, min(depth) as distance from up where anc <> node group by all""",
    "p7_paths": f"""{_UP},
onward as (select r.node, r.root, min(l.parent) as parent from reach r join links l on l.node = r.node join reach a on a.node = l.parent and a.root = r.root and a.depth = r.depth - 1 group by all),
path as (select node, root, 0 as depth, node as path from reach where depth = 0 union all select o.node, o.root, p.depth + 1, p.path || '/' || o.node from path p join onward o on o.parent = p.node and o.root = p.root),
below as (select anc as node, count(distinct node) as n from up where anc <> node group by 1)
select n.node as term_id, p.root as root_id, p.depth, p.path, coalesce(b.n, 0) as n_descendants from nodes n left join path p on p.node = n.node left join below b on b.node = n.node""",
}
