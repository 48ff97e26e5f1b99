"""The scoring plan: tree shortcut for safe leaves, neighbour search for the rest, fail-open for malformed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import ivf, tree
from riskloom.operators.blocks import member_pages, nearest_in_pages
from riskloom.operators.boxtree import BoxTree
from riskloom.operators.features import vectorize
from riskloom.operators.knn import knn_exact, vote
from riskloom.sources.requests import flatten_payload, parse_payload
from riskloom.sources.shared import write_table


def respond(voted: DataFrame) -> DataFrame:
    """voted (query_id, n) with approved, fraud_score and the response as JSON text."""
    out = voted.withColumn("approved", S.approved(F.col("n"))).withColumn("fraud_score", S.fraud_score(F.col("n")))
    return out.withColumn("response", F.to_json(F.struct("approved", "fraud_score")))


def score_exact(queries: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    return respond(vote(knn_exact(queries, members, k), queries))


def score_staged(queries: DataFrame, pages: DataFrame, index: BoxTree, nodes: DataFrame, leaves: DataFrame, dims: int = S.DIMS) -> DataFrame:
    """(query_id, n, approved, fraud_score, response). leaves: leaf_id, count, safe. Only rows outside safe leaves are searched."""
    placed = tree.leaf_lookup(tree.predict(queries, nodes), leaves)
    quick = placed.where(F.coalesce("safe", F.lit(False)))
    rest = placed.where(~F.coalesce("safe", F.lit(False))).select("vec_id", "q")
    searched = ivf.search_cascade(rest, pages, index, dims)
    return respond(quick.select(F.col("vec_id").alias("query_id"), F.col("count").cast("int").alias("n")).unionByName(searched))


def request_vectors(requests: DataFrame, id_col: str, body: str = "body") -> DataFrame:
    """(id, malformed, q) of JSON requests; works on batches and streams."""
    rows = flatten_payload(parse_payload(requests, body))
    out = vectorize(rows, [id_col, "malformed"])
    return out.select(F.col(id_col).alias("vec_id"), "malformed", "q")


def score_requests(requests: DataFrame, id_col: str, members: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, n, approved, fraud_score, response) of JSON requests; malformed ones are approved with score 0."""
    return score_by_pages(requests, id_col, member_pages(members), k)


def score_by_pages(requests: DataFrame, id_col: str, pages: DataFrame, k: int = 5) -> DataFrame:
    """``score_requests`` by pages of the members that were made before; requests are parsed once."""
    vectors = write_table(request_vectors(requests, id_col), "requests")
    good = vectors.where(~F.col("malformed")).select("vec_id", "q")
    bad = vectors.where("malformed").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("n"))
    return respond(vote(nearest_in_pages(good, pages, S.DIMS, k), good).unionByName(bad))
