"""Evidence records to concept documents with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T

# Evidence types that are queries, and those that are prose.
QUERY_TYPES = ["failed_query", "query", "clicked_query", "search_log", "manual_search", "query_log"]
PROSE_TYPES = ["reviewed_snippet", "clinical_snippet", "patient_language", "prose", "note", "snippet"]


def keep(df: DataFrame, include: dict[str, list[str]], exclude: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns are in every included set and in no excluded one; null is in no set."""
    for c, values in include.items():
        df = df.where(F.coalesce(F.col(c).isin(values), F.lit(False)))
    for c, values in exclude.items():
        df = df.where(~F.coalesce(F.col(c).isin(values), F.lit(False)))
    return df


def view_of(kind: Column) -> Column:
    key = F.replace(T.normalized_key(kind), F.lit(" "), F.lit("_"))
    return F.when(key.isin(QUERY_TYPES), "query_language").when(key.isin(PROSE_TYPES), "prose_evidence").when(F.coalesce(key, F.lit("")) == "", "evidence").otherwise(key)


def top_texts(evidence: DataFrame, most: int) -> DataFrame:
    """Per concept and view the best row of each normalised text by weight, text and evidence id, then the best
    ``most`` of these: cui, view, place, norm, text, weight, evidence_id. Null weights count as 1."""
    e = evidence.where("text is not null").select("cui", "view", T.normalized_key(F.col("text")).alias("norm"), "text", F.coalesce("weight", F.lit(1.0)).alias("weight"), "evidence_id", "row_id")
    order = F.struct((-F.col("weight")).alias("w"), "text", "evidence_id", "row_id")
    once = e.groupBy("cui", "view", "norm").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("cui", "view").orderBy("o.w", "o.text", "o.evidence_id", "o.row_id"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("cui", "view", "place", "norm", "o.text", (-F.col("o.w")).alias("weight"), "o.evidence_id")


def concept_documents(evidence: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """One document per concept and view: id, evidence count, and the text with labels (cui, labels) and evidence
    bullets, weights shown where they are not 1."""
    bullet = F.concat(F.lit("- "), F.col("text"), F.when(F.col("weight") == 1, "").otherwise(F.concat(F.lit(" (weight "), F.round("weight", 3).cast("string"), F.lit(")"))))
    body = top_texts(evidence, most).select("cui", "view", F.struct("place", bullet.alias("line")).alias("b")).groupBy("cui", "view").agg(F.sort_array(F.collect_list("b")).alias("b"))
    count = evidence.groupBy("cui", "view").agg(F.count("*").alias("evidence_count"))
    whole = body.join(count, ["cui", "view"]).join(labels, "cui", "left")
    lab = F.when(F.col("labels").isNotNull(), F.concat(F.array(F.lit("Labels:")), F.transform("labels", lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("CUI: "), F.col("cui")), F.concat(F.lit("Evidence view: "), F.col("view"))), lab, F.array(F.lit("Evidence:")), F.transform("b", lambda x: x["line"]))
    return whole.select(F.concat_ws(":", "cui", "view").alias("doc_id"), "cui", "view", "evidence_count", F.array_join(lines, "\n").alias("text"))


def parse_bullets(documents: DataFrame) -> DataFrame:
    """The evidence bullets of concept documents: doc_id, place, text, weight."""
    after = F.element_at(F.split("text", "\nEvidence:\n", 2), 2)
    lines = documents.select("doc_id", F.posexplode(F.split(after, "\n- ")).alias("p", "line"))
    line = F.regexp_replace("line", "^- ", "")
    tail = r" \(weight ([0-9.E-]+)\)$"
    return lines.select("doc_id", (F.col("p") + 1).alias("place"), F.regexp_replace(line, tail, "").alias("text"), F.coalesce(F.when(line.rlike(tail), F.regexp_extract(line, tail, 1).cast("double")), F.lit(1.0)).alias("weight"))


def first_sources(evidence: DataFrame, most: int) -> DataFrame:
    """Per concept, view and text the first ``most`` citations in order of arrival (row_id), each source once."""
    e = evidence.where("text is not null").select("cui", "view", F.sha2("text", 256).alias("text_hash"), F.coalesce("source", F.lit("")).alias("source"), "evidence_id", "row_id")
    once = e.groupBy("cui", "view", "text_hash", "source").agg(F.min("row_id").alias("row_id"), F.min_by("evidence_id", "row_id").alias("evidence_id"))
    place = F.row_number().over(Window.partitionBy("cui", "view", "text_hash").orderBy("row_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= most)
