"""From a query's tree to DataFrame operations over postings.

``matching`` is the plan for searches: one scan of the query's terms, one shuffle by document into a map from term to
positions, and the whole tree as one predicate on that map. ``matching_sets`` builds the same result from semi, anti
and union operations, an operator per node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import All, Any, Node, Phrase, Without, Word, terms_of

KEY = ["chunk", "doc_idx"]


def _starts(at, terms: tuple[str, ...]) -> Column:
    """Positions where the phrase starts."""
    def shifted(t: str, k: int) -> Column:
        return F.transform(at(t), lambda x: x - k) if k else at(t)

    return reduce(F.array_intersect, [shifted(t, k) for k, t in enumerate(terms)])


def predicate(node: Node) -> Column:
    """Whether a document's map ``m`` from term to positions satisfies the tree."""
    match node:
        case Word(term):
            return F.map_contains_key("m", F.lit(term))
        case Phrase(terms):
            return F.coalesce(F.size(_starts(lambda t: F.col("m")[t], terms)) > 0, F.lit(False))
        case All(parts):
            return reduce(lambda a, b: a & b, map(predicate, parts))
        case Any(parts):
            return reduce(lambda a, b: a | b, map(predicate, parts))
        case Without(wanted, unwanted):
            return predicate(wanted) & ~reduce(lambda a, b: a | b, map(predicate, unwanted))


def matching(postings: DataFrame, node: Node, field: str = "body") -> DataFrame:
    """chunk, doc_idx, m of the documents that match."""
    wanted = sorted(set(terms_of(node)))
    scan = postings.filter(F.col("term").isin(wanted) & (F.col("field") == field))
    maps = scan.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    return maps.filter(predicate(node))


def matching_sets(postings: DataFrame, node: Node, field: str = "body") -> DataFrame:
    """chunk, doc_idx of the documents that match, by one relational operator per node."""
    match node:
        case Word(term):
            return postings.filter((F.col("term") == term) & (F.col("field") == field)).select(*KEY).distinct()
        case Phrase(terms):
            rows = [postings.filter((F.col("term") == t) & (F.col("field") == field)).select(*KEY, F.explode("positions").alias("p")).withColumn("p", F.col("p") - k) for k, t in enumerate(terms)]
            return reduce(lambda a, b: a.join(b, [*KEY, "p"]), rows).select(*KEY).distinct()
        case All(parts):
            sets = [matching_sets(postings, p, field) for p in parts]
            return reduce(lambda a, b: a.join(b, KEY, "left_semi"), sets)
        case Any(parts):
            return reduce(DataFrame.unionByName, [matching_sets(postings, p, field) for p in parts]).distinct()
        case Without(wanted, unwanted):
            return reduce(lambda a, b: a.join(b, KEY, "left_anti"), [matching_sets(postings, p, field) for p in unwanted], matching_sets(postings, wanted, field))
