"""What changed between two releases, and which vectors can be kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(atoms: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n_atoms, fingerprint): SHA-256 over the sorted distinct digests of a key's rows, whatever their order.
    Digests, not rows, are gathered; a key has as many as it has distinct rows."""
    digest = F.sha2(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    sets = atoms.select(key, digest.alias("d")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return sets.select(key, F.size("ds").cast("long").alias("n_atoms"), F.sha2(F.array_join("ds", "\n"), 256).alias("fingerprint"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed; what is equal does not come out."""
    both = old.select(key, F.col("fingerprint").alias("a")).join(new.select(key, F.col("fingerprint").alias("b")), key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def reuse_plan(new_docs: DataFrame, old_docs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(doc_id, action, reason) for each new document (doc_id, text_hash): reuse its newest old vector (doc_id,
    text_hash, order, vector) if text and length agree, else embed it again."""
    newest = vectors.groupBy("doc_id").agg(F.max_by(F.struct(F.col("text_hash").alias("v_hash"), F.size("vector").alias("n")), "order").alias("v"))
    joined = new_docs.select("doc_id", "text_hash").join(old_docs.select("doc_id", F.col("text_hash").alias("old_hash")), "doc_id", "left").join(newest, "doc_id", "left")
    reason = (
        F.when(F.col("old_hash").isNull(), "new_document").when(F.col("old_hash") != F.col("text_hash"), "text_changed").when(F.col("v").isNull(), "no_vector")
        .when(F.coalesce("v.n", F.lit(-1)) != dims, "wrong_length").when(~F.col("v.v_hash").eqNullSafe(F.col("text_hash")), "vector_of_other_text").otherwise("unchanged")
    )
    return joined.select("doc_id", F.when(reason == "unchanged", "reuse").otherwise("embed").alias("action"), reason.alias("reason"))


def assembly_problems(manifest: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(doc_id, problem) of vectors (doc_id, vector) against a manifest (doc_id): missing, extra, duplicate, length."""
    counts = vectors.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.coalesce(F.size("vector"), F.lit(-1)) != dims, 1).otherwise(0)).alias("bad"))
    both = manifest.select("doc_id").distinct().withColumn("m", F.lit(1)).join(counts, "doc_id", "full_outer")
    found = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("m").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("bad") == 1, "length")))
    return both.select("doc_id", F.explode(found).alias("problem"))
