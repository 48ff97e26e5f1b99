"""Calibration of tree leaves against the neighbour vote, and confusion analysis.

scored: one row per entry with leaf_id, n (frauds by neighbours), tree_n, purity_milli and expected_approved. All results
are aggregations by leaf, so they are as small as the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.functions.scalars import approved

MIN_OBS = 50


def confusion(scored: DataFrame, n: str = "n") -> DataFrame:
    """(tp, tn, fp, fn); positive is a denial."""
    ok, want = approved(F.col(n)), F.col("expected_approved")
    return scored.agg(F.count_if(~ok & ~want).alias("tp"), F.count_if(ok & want).alias("tn"), F.count_if(~ok & want).alias("fp"), F.count_if(ok & ~want).alias("fn"))


def observed(scored: DataFrame, observation: Observation, pure: int, n: str = "n") -> DataFrame:
    """scored, which fills the observation when it is written: entries, those in leaves of ``pure`` thousandths or more, those whose leaf agrees, and the confusion."""
    ok, want = approved(F.col(n)), F.col("expected_approved")
    return scored.observe(
        observation,
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("purity_milli") >= pure).alias("n_pure"),
        F.count_if(F.col("tree_n") == F.col(n)).alias("n_agree"),
        F.count_if(~ok & ~want).alias("tp"),
        F.count_if(ok & want).alias("tn"),
        F.count_if(~ok & want).alias("fp"),
        F.count_if(ok & ~want).alias("fn"),
    )


def leaf_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("leaf_id").agg(F.count("*").alias("n_obs"))


def leaf_score_histogram(scored: DataFrame) -> DataFrame:
    """(leaf_id, n_distinct, hist): how often each n occurs, as a map."""
    each = scored.groupBy("leaf_id", "n").agg(F.count("*").alias("c"))
    return each.groupBy("leaf_id").agg(F.count("*").alias("n_distinct"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("n", "c")))).alias("hist"))


def leaf_summary(scored: DataFrame) -> DataFrame:
    """Everything that admission looks at, in one aggregation."""
    return scored.groupBy("leaf_id").agg(
        F.count("*").alias("n_obs"),
        F.count_distinct("n").alias("n_knn"),
        F.count_distinct("tree_n").alias("n_tree"),
        F.min("n").alias("knn_n"),
        F.min("tree_n").alias("tree_n"),
        F.min("purity_milli").alias("purity_milli"),
    )


def reject_reason(min_obs: int = MIN_OBS, min_obs_pure: int | None = None) -> Column:
    """Why a leaf of leaf_summary is not safe, in the order of the tests; null if it is safe."""
    pure = min_obs if min_obs_pure is None else min_obs_pure
    c = F.col
    enough = (c("n_obs") >= min_obs) | ((c("purity_milli") == 1000) & (c("n_obs") >= pure))
    return (
        F.when(c("n_obs").isNull(), "unseen")
        .when(~enough, "min_obs")
        .when(c("n_knn") != 1, "mixed")
        .when((c("n_tree") != 1) | (c("tree_n") != c("knn_n")), "tree_mismatch")
    )


def judge_leaves(scored: DataFrame, leaf_ids: DataFrame, min_obs: int = MIN_OBS, min_obs_pure: int | None = None) -> DataFrame:
    """leaf_summary of all leaves (those that no entry meets as well), with reason and safe."""
    out = leaf_ids.select("leaf_id").join(leaf_summary(scored), "leaf_id", "left")
    out = out.withColumn("reason", reject_reason(min_obs, min_obs_pure))
    return out.withColumn("safe", F.col("reason").isNull())


def safe_leaves(judged: DataFrame) -> DataFrame:
    return judged.where("safe").select("leaf_id", F.col("knn_n").alias("n"), "n_obs")


def reject_reasons(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n_leaves"))


def coverage(judged: DataFrame) -> DataFrame:
    """(n_safe, n_all, coverage): the share of entries that fall in safe leaves."""
    safe, every = F.sum(F.when(F.col("safe"), F.col("n_obs")).otherwise(0)), F.sum(F.coalesce("n_obs", F.lit(0)))
    return judged.agg(safe.alias("n_safe"), every.alias("n_all")).withColumn("coverage", F.col("n_safe") / F.col("n_all"))


def purity_tiers(leaves: DataFrame) -> DataFrame:
    p = F.col("purity_milli")
    return leaves.agg(F.count_if(p == 1000).alias("pure"), F.count_if((p >= 950) & (p < 1000)).alias("high"), F.count_if(p < 950).alias("rest"))


def top_leaves(judged: DataFrame, most: int = 30) -> DataFrame:
    seen = judged.where("n_obs IS NOT NULL")
    return seen.orderBy(F.desc("n_obs"), "leaf_id").limit(most).select("leaf_id", "n_obs", "n_knn", "purity_milli")


def audit(shipped: DataFrame, judged: DataFrame) -> DataFrame:
    """Shipped safe leaves (leaf_id, n) that the entries do not confirm: never seen, mixed, or with another n."""
    both = shipped.select("leaf_id", F.col("n").alias("shipped_n")).join(judged.select("leaf_id", "n_obs", "n_knn", "knn_n"), "leaf_id", "left")
    return both.where(F.col("n_obs").isNull() | (F.col("n_knn") != 1) | (F.col("knn_n") != F.col("shipped_n"))).select("leaf_id", "shipped_n", "n_obs", "knn_n")


def union_safe(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("leaf_id").unionByName(two.select("leaf_id")).distinct()


def added_safe(shipped: DataFrame, found: DataFrame) -> DataFrame:
    return found.select("leaf_id").exceptAll(shipped.select("leaf_id"))


def safe_leaf_ids(judged: DataFrame) -> DataFrame:
    """One row: the sorted ids of safe leaves; a tree bounds the list."""
    return judged.where("safe").agg(F.sort_array(F.collect_list("leaf_id")).alias("leaf_ids"))


def emit_rows(judged: DataFrame, width: int = 16) -> DataFrame:
    """(row, line): the safe flags of all leaves as text, ``width`` to a line."""
    row = F.floor(F.col("leaf_id") / width).cast("int").alias("row")
    flags = F.sort_array(F.collect_list(F.struct("leaf_id", F.col("safe").cast("string").alias("flag"))))
    return judged.groupBy(row).agg(F.concat_ws(", ", F.transform(flags, lambda x: x["flag"])).alias("line"))
