"""Mixing sources to target weights, in DataFrame operations only.

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
``MAX_EPOCHS`` times its source's size, and the excess is shared again by weight. A document is a row of blocks of
``block_words`` words. A source's quota is its target in whole words: all its blocks as often as they fit, then blocks in the
order of a keyed hash until the rest is reached, the last one in part, so that the quota is met to the word.

The drawn blocks are dealt to output shards by a multivariate-hypergeometric splitting tree: the vector of block quotas
by stratum is split between two halves of the shards by hypergeometric draws, and so on down to single shards. Each
shard then takes its own range of each stratum's permuted blocks, and orders its blocks by another hash. A source's
stratum is its place in code-point order modulo ``STRATA``, so up to so many sources have one each; within a stratum the random permutation
splits its sources, again hypergeometrically. The number of shards follows from the words of the mix, ``MAX_SHARDS`` at most; a large shard is
written by several tasks. The tree on the driver so has at most STRATA * MAX_SHARDS cells.

Ranks come from a histogram of hash prefixes and a row number within one prefix, so that no task holds a whole source. One task sorts
the list of sources, a row of numbers each: weights go by place in that list.

Defined cases: a null text has size 0; a null source is a source; sources without words get 0; rows that repeat are
further documents; null doc_ids are allowed; an empty table gives an empty mix; further columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, discard, listed

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
SEED = "mix-1"
STRATA, MAX_SHARDS = 1024, 2048
#: Words of a shard, and of a task that writes a shard or a part of it.
SHARD_WORDS, TASK_WORDS = 4_000_000, 32_000_000
#: Sources up to which their parameters are broadcast (under 1 MB); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words_in(c: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("bigint")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, copy_of: copy_of numbers rows that agree in the others."""
    rows = docs.select("doc_id", "source", words_in().alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    return rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("copy_of"))


def plan_targets(rows: DataFrame) -> DataFrame:
    """source, stratum, source_size, target, epochs, rest: one row per source."""
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_name) - 1).withColumn("stratum", F.col("place") % STRATA)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)) + 1).cast("bigint"))
    s = s.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    everything, before = W.partitionBy(), by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("words", F.sum("source_size").over(everything)).withColumn("weights", F.sum("w").over(everything))
    s = s.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("open") <= F.col("w") * F.col("left"))
    held = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * (F.col("words") - held("cap"))).cast("double") / (F.col("weights") - held("w"))))
    s = s.withColumn("quota", F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.col("cap")))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("bigint"))
    return s.select("source", "stratum", "source_size", "target", "epochs", (F.col("quota") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad, by inversion outwards from the mode."""
    low, high, total = max(0, draws - bad), min(draws, good), good + bad
    if low == high:
        return low
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u, down, up, pd, pu = rng.random() - p, mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
    return mode


def split_quotas(quotas: list[int], shards: int, seed: str = SEED) -> list[list[int]]:
    """Blocks of each stratum for each shard: shards differ by one block at most in total, columns add up to the quotas."""
    rng = random.Random(seed)

    def down(vector: list[int], count: int) -> list[list[int]]:
        if count == 1:
            return [vector]
        left_shards = count // 2
        total = sum(vector)
        draws = left = total * left_shards // count
        pool, one = total, []
        for q in vector:
            x = _hypergeometric(rng, q, pool - q, left)
            one.append(x)
            pool -= q
            left -= x
        assert sum(one) == draws
        return down(one, left_shards) + down([q - x for q, x in zip(vector, one, strict=True)], count - left_shards)

    return down(quotas, shards)


def draw(rows: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, copy_of, stratum, epoch, block, words: the blocks that the mix takes, the last of a source in part.

    ``block_words`` 0: a document is one block, which is taken whole or not at all; quotas are then met to one document.
    """
    whole = block_words == 0
    count = F.lit(1).cast("bigint") if whole else F.ceil(F.col("size") / block_words)
    blocks = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    blocks = blocks.withColumn("words", F.col("size") if whole else F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *(F.col(c).cast("string") for c in ("size", "copy_of", "block"))))
    blocks = blocks.withColumn("key", key).withColumn("prefix", F.substring("key", 1, 3))
    few = targets.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # Where each source's rest runs out: the prefix first, then the exact block within it.
    upto = W.partitionBy("source").orderBy("prefix")
    marks = blocks.groupBy("source", "prefix").agg(F.sum("words").alias("here")).withColumn("before", F.sum("here").over(upto) - F.col("here"))
    t = targets.withColumnRenamed("source", "of")
    edge = marks.join(small(t), F.col("source").eqNullSafe(F.col("of"))).filter("before < rest and rest <= before + here").select("of", F.col("prefix").alias("edge"), "before")
    edge = cut(edge, "mix-edges")
    plan = t.join(edge.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").select("of", "stratum", "epochs", "rest", "edge", "before")
    known = blocks.join(small(plan), F.col("source").eqNullSafe(F.col("of")))
    inside = F.coalesce(F.col("prefix") == F.col("edge"), F.lit(False))
    clear = known.filter(~inside).withColumn("extra", F.when(F.coalesce(F.col("prefix") < F.col("edge"), F.lit(False)), F.col("words")).otherwise(F.lit(0).cast("bigint")))
    upto = W.partitionBy("source").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    over = known.filter(inside).withColumn("upto", F.col("before") + F.sum("words").over(upto) - F.col("words"))
    space = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("words"), F.col("rest") - F.col("upto")))
    if whole:  # the document at the edge comes whole if most of it fits
        space = F.when(space * 2 >= F.col("words"), F.col("words")).otherwise(F.lit(0).cast("bigint"))
    both = clear.unionByName(over.withColumn("extra", space).drop("upto"))
    taken = F.concat(
        F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("epochs")), lambda e: F.struct((e - 1).alias("epoch"), F.col("words").alias("words")))).otherwise(F.array().cast("array<struct<epoch:bigint,words:bigint>>")),
        F.when(F.col("extra") > 0, F.array(F.struct(F.col("epochs").alias("epoch"), F.col("extra").alias("words")))).otherwise(F.array().cast("array<struct<epoch:bigint,words:bigint>>")))
    return both.withColumn("d", F.explode(taken)).select("doc_id", "source", "size", "copy_of", "stratum", "d.epoch", "block", "d.words")


def shards_for(words: int) -> int:
    return max(1, min(MAX_SHARDS, math.ceil(words / SHARD_WORDS)))


def deal(drawn: DataFrame, shards: int | None = None, seed: str = SEED) -> DataFrame:
    """``drawn`` with shard, place and task: its shard by the splitting tree, its order in the shard, and the task that writes it."""
    salt = F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "size", "copy_of", "epoch", "block")))
    rows = drawn.withColumn("salt", salt).withColumn("bin", F.shiftrightunsigned("salt", 52))
    bins = cut(rows.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")), "mix-bins")
    found = bins.groupBy("stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # STRATA rows at most
    quotas, words = {r.stratum: r.n for r in found}, sum(r.words for r in found)
    shards = shards or shards_for(words)
    tasks = max(1, math.ceil(words / shards / TASK_WORDS))  # of a shard
    strata = sorted(quotas)
    leaves = split_quotas([quotas[s] for s in strata], shards, seed)
    offsets, at = [], dict.fromkeys(strata, 0)
    for j, leaf in enumerate(leaves):
        for s, n in zip(strata, leaf, strict=True):
            if n:
                offsets.append((s, at[s], at[s] + n, j))
            at[s] += n
    bounds = listed(drawn.sparkSession, offsets, "stratum int, low bigint, high bigint, shard int").groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("low", "shard"))).alias("cuts"))
    upto = W.partitionBy("stratum").orderBy("bin")
    bins = bins.withColumn("first", F.sum("n").over(upto) - F.col("n")).select("stratum", "bin", "first")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("stratum", "bin").orderBy("salt", "size", "doc_id", "copy_of", "epoch", "block")) - 1)
    ranked = ranked.join(bins, ["stratum", "bin"]).withColumn("rank", F.col("first") + F.col("rank")).drop("first")
    # At most STRATA rows of at most `shards` cuts each.
    placed = ranked.join(F.broadcast(bounds), "stratum").withColumn("shard", F.element_at(F.filter("cuts", lambda c: c["low"] <= F.col("rank")), -1)["shard"])
    placed = placed.withColumn("place", F.shiftrightunsigned(F.xxhash64("salt", F.lit("place")), 1))
    part = F.least(F.lit(tasks - 1), F.floor(F.col("place") / F.lit(2.0**63) * tasks)).cast("int")  # a shard's tasks hold ranges of its order
    return placed.select(*drawn.columns, "shard", "place", (F.col("shard") * tasks + part).cast("int").alias("task"))


def _in_order(dealt: DataFrame, task: str = "task", place: str = "place") -> DataFrame:
    """Each task's rows in one partition, in their order."""
    n = (dealt.agg(F.max(task)).first()[0] or 0) + 1
    return dealt.repartitionById(n, F.col(task)).sortWithinPartitions(task, place)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, targets, blocks): the documents' sizes, a row per source, and the mix itself, written shard by shard in its final order."""
    rows = cut(units(docs), "mix-units")
    targets = cut(plan_targets(rows), "mix-targets")
    drawn = cut(draw(rows, targets, block_words, seed), "mix-drawn")
    dealt = cut(deal(drawn, shards, seed), "mix-dealt")
    out = cut(_in_order(dealt), "mix")
    discard(drawn, dealt)
    return rows, targets, out


def taken_words(rows: DataFrame, targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, a row per document."""
    key = ["doc_id", "source", "size", "copy_of"]
    sums = blocks.groupBy(*key).agg(F.sum("words").alias("taken")).select(*(F.col(k).alias(f"of_{k}") for k in key), "taken")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    few = targets.count() <= BROADCAST_SOURCES
    t = targets.select(F.col("source").alias("name"), "source_size", "target")
    return rows.join(sums, same, "left").join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


#: Rows of the mix up to which it is broadcast to the documents (some 60 bytes each); beyond, both are shuffled.
BROADCAST_ROWS = 500_000


#: Rows of one id, source and size that a task numbers.
SALT_ROWS = 10_000


def _numbered(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` (row, the keys, c: rows of the key) with copy_of: numbers the rows of a key from 0. Equal rows are folded first and a key's rows are spread over tasks."""
    folded = rows.withColumn("js", F.to_json("row")).groupBy("js", *keys).agg(F.first("row").alias("row"), F.first("c").alias("c"), F.count(F.lit(1)).alias("m"))
    folded = folded.withColumn("salt", F.pmod(F.xxhash64("js"), F.ceil(F.col("c") / SALT_ROWS).cast("bigint")))
    here = folded.groupBy(*keys, "salt").agg(F.sum("m").alias("here")).withColumn("first", F.sum("here").over(W.partitionBy(*keys).orderBy("salt")) - F.col("here"))
    here = here.select(*(F.col(k).alias(f"at_{k}") for k in keys), F.col("salt").alias("at_salt"), "first")
    inside = F.sum("m").over(W.partitionBy(*keys, "salt").orderBy("js").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    joined = folded.withColumn("inside", inside).join(here, [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in (*keys, "salt")])
    start = F.col("first") + F.col("inside")
    return joined.withColumn("copy_of", F.explode(F.sequence(start, start + F.col("m") - 1))).select("row", *keys, "copy_of")


def mix_documents(docs: DataFrame, shards: int | None = None, seed: str = SEED) -> DataFrame:
    """The mix as rows of ``docs`` with all their columns, whole documents as often as the mix takes them, shard by shard.

    Quotas are met to half a document: the one at a source's edge comes whole or not at all.
    """
    rows, _, blocks = mix(docs, 0, shards, seed)
    key = ("doc_id", "source", "size", "copy_of")
    mixed = blocks.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("task").alias("__task"), F.col("place").alias("__place"))
    inner = docs.select(F.struct("*").alias("row"), "doc_id", "source", words_in().alias("size"))
    ties = rows.filter("copy_of > 0").groupBy(*key[:3]).agg((F.max("copy_of") + 1).alias("c"))
    ties = cut(ties.select(*(F.col(k).alias(f"__{k}") for k in key[:3]), "c"), "mix-ties")
    discard(rows)
    same = lambda n: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key[:n]]
    if ties.isEmpty():
        numbered = inner.withColumn("copy_of", F.lit(0).cast("bigint"))
    else:  # rows that agree in id, source and size are told apart by number
        single = inner.join(ties, same(3), "left_anti").withColumn("copy_of", F.lit(0).cast("bigint"))
        numbered = single.unionByName(_numbered(inner.join(ties, same(3)).select("row", *key[:3], "c"), key[:3]))
    out = numbered.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, same(4))
    n = (mixed.agg(F.max("__task")).first()[0] or 0) + 1
    return out.repartitionById(n, F.col("__task")).sortWithinPartitions("__task", "__place").select("row.*")
