"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are ordered by a row of random sign hashes (read as one number, so that a shared
prefix brings vectors together) and each is compared with the ``WINDOW`` that follow, by cosine in double precision.
Verified pairs are united across passes. The number of passes follows from the largest label's size, so that a pair at
the threshold is found with probability ``RECALL``: of two vectors at 0.93, a hash agrees with probability 0.88, and
the first ``depth`` of them must. This holds however the vectors lie, as cells of vectors that agree in these hashes and
are larger than the window are compared in full, block against block.

Equal vectors are one class, compared once. A pass keeps of its verified pairs a spanning forest per task, and the
links of a vector are then counted within its component, block against block, so large groups of near copies are
neither expanded into pairs nor cut off by the window.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null,
links with nothing; vectors of unequal length don't link; a null vec_id links with nothing; rows that repeat a vec_id
are vectors of their own which share a component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ship, tidy
from .graph import components, skew_join
from .runs import key_runs

MIN_COSINE = 0.93
WINDOW, RECALL = 64, 0.9995
HASHES = 62
#: Vectors per block when links are counted.
BLOCK = 128
#: Crowded cells of a pass up to which their keys are broadcast (16 bytes each).
BROADCAST_CELLS = 100_000


def depth(largest: int) -> int:
    """Leading hashes that would leave WINDOW vectors of the largest label in a cell, if each halved it."""
    return max(0, math.ceil(math.log2(max(largest, 1) / WINDOW)))


def passes(largest: int) -> int:
    """Passes for the largest label."""
    agree = 1 - math.acos(MIN_COSINE) / math.pi
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree ** depth(largest), 0.95))))


def _planes(number: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([number, dim])).standard_normal((dim, HASHES))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow for large components
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(ids: np.ndarray, label: np.ndarray, unit: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified pairs at most WINDOW apart, of which the later one is at ``fresh`` or after."""
    n = len(ids)
    parent = np.arange(n)
    a, b = [], []
    for k in range(1, min(WINDOW, n - 1) + 1):
        to = np.arange(max(fresh, k), n)
        to = to[label[to] == label[to - k]]
        if not len(to):
            continue
        to = to[np.einsum("ij,ij->i", unit[to], unit[to - k]) >= MIN_COSINE]
        root = parent
        while (root != root[root]).any():
            root = root[root]
        parent = root.copy()
        for j in to[root[to] != root[to - k]].tolist():
            x, y = _find(parent, j), _find(parent, j - k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(ids[j - k])
                b.append(ids[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _coded(unit: np.ndarray, number: int, dim: int, planes: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The code of each vector in a pass: its hashes as one number, the first one highest."""
    if (number, dim) not in planes:
        planes[number, dim] = _planes(number, dim)
    return (unit @ planes[number, dim] > 0) @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))


def _pass(classes: DataFrame, number: int, bits: int, crowded: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of one pass. A task holds whole cells of equal leading ``bits``, so no window is cut off; crowded cells are left out."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            code = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                code[at] = _coded(_unit(_matrix(batch.column(2).take(pa.array(at)))), number, dim, planes)
            yield pa.record_batch({"group_id": batch.column(0), "cell": code >> (HASHES - bits), "code": code, "rep": batch.column(1), "embedding": batch.column(2)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[str, np.ndarray] | None = None
        for batch in batches:
            group, rep = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            lengths = batch.column(3).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():  # a group has one length
                at = np.flatnonzero(lengths == dim)
                now = {"id": rep[at], "group": group[at], "unit": _unit(_matrix(batch.column(3).take(pa.array(at))))}
                fresh = 0
                if tail is not None and tail["unit"].shape[1] == dim:
                    fresh = len(tail["id"])
                    now = {k: np.concatenate([tail[k], now[k]]) for k in now}
                a, b = _compare(now["id"], now["group"], now["unit"], fresh)
                if len(a):
                    yield pa.record_batch({"a": a, "b": b})
                tail = {k: v[-WINDOW:] for k, v in now.items()}

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.select("group_id", "rep", "embedding").mapInArrow(coded, f"group_id bigint, cell bigint, code bigint, rep bigint, embedding {classes.schema['embedding'].dataType.simpleString()}")
    left_out = crowded.filter(F.col("pass") == number).select("group_id", "cell")
    ordered = ordered.join(F.broadcast(left_out) if left_out.count() <= BROADCAST_CELLS else left_out, ["group_id", "cell"], "left_anti").select("group_id", "cell", "code", "rep", "embedding")
    sorted_ = ordered.repartition(n, "group_id", "cell").sortWithinPartitions("group_id", "code", "rep").select("group_id", "code", "rep", "embedding")
    return sorted_.mapInArrow(tidy(compared), "a bigint, b bigint")


def _forest(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows and columns of a spanning forest of the bipartite graph ``hit``."""
    rows, cols = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
    a, b = [], []
    for start in np.flatnonzero(hit.any(axis=1)).tolist():
        todo = [] if rows[start] else [start]
        rows[start] = True
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(hit[r] & ~cols).tolist():
                cols[c] = True
                a.append(r)
                b.append(c)
                more = np.flatnonzero(hit[:, c] & ~rows).tolist()
                rows[more] = True
                a += more
                b += [c] * len(more)
                todo += more
    return a, b


def _cells(classes: DataFrame, bits: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(cells, crowded): pass, group_id, cell, node, key of each vector in each pass; and the cells that hold more than WINDOW, with n and blocks."""

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == dim))
                unit = _unit(_matrix(batch.column(2).take(at)))
                for number in range(count):
                    cell = _coded(unit, number, dim, planes) >> (HASHES - bits)
                    yield pa.record_batch({"pass": np.full(len(at), number), "group_id": batch.column(0).take(at), "cell": cell, "node": batch.column(1).take(at)})

    cells = classes.select("group_id", "rep", "embedding").mapInArrow(tidy(celled), "pass bigint, group_id bigint, cell bigint, node bigint")
    cells = cut(cells.withColumn("key", F.xxhash64("pass", "group_id", "cell")), "vector-cells")
    crowded = cells.groupBy("key", "pass", "group_id", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WINDOW)
    return cells, cut(crowded.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("bigint")), "vector-crowded")


def _crowded(classes: DataFrame, cells: DataFrame, crowded: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of all passes within crowded cells, a spanning forest per pair of blocks."""
    rows = cells.select("key", "group_id", "node")
    placed = skew_join(rows, crowded.select("key", "n", "blocks"), "key", cells.count()).join(classes.select(F.col("rep").alias("node"), "group_id", "embedding"), ["node", "group_id"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    upto = lambda a, b: F.explode(F.sequence(a, b))
    zero = F.lit(0).cast("bigint")
    one = placed.select("key", block.alias("i"), upto(block, F.col("blocks") - 1).alias("j"), F.lit(0).alias("side"), "group_id", "node", "embedding")
    two = placed.select("key", upto(zero, block).alias("i"), block.alias("j"), F.lit(1).alias("side"), "group_id", "node", "embedding")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.unionByName(two).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "group_id", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, stop in key_runs(batches, 3):
            part = batch.slice(start, stop - start)
            left = int(np.count_nonzero(part.column(3).to_numpy() == 0))
            group, ids = part.column(4).to_numpy(), part.column(5).to_numpy()
            if len(np.unique(part.column(6).value_lengths().to_numpy())) > 1:
                raise ValueError("two cells with one hash")
            unit = _unit(_matrix(part.column(6)))
            hit = (unit[:left] @ unit[left:].T >= MIN_COSINE) & (group[:left, None] == group[None, left:]) & (ids[:left, None] != ids[None, left:])
            a, b = _forest(hit)
            if a:
                yield pa.record_batch({"a": ids[:left][a], "b": ids[left:][b]})

    return dealt.mapInArrow(tidy(compared), "a bigint, b bigint")


def _linked(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(rep, others): vectors of other classes that each class links with."""
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("bigint")), "vector-sizes")
    placed = skew_join(comp, sizes, "component", comp.count()).join(classes.select(F.col("rep").alias("node"), "embedding", "m"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    upto = lambda a, b: F.explode(F.sequence(a, b))
    # Blocks i <= j meet once, and count for both.
    one = placed.select("component", block.alias("i"), upto(block, F.col("blocks") - 1).alias("j"), F.lit(0).alias("side"), "node", "m", "embedding")
    two = placed.filter("blocks > 1").select("component", upto(F.lit(0).cast("bigint"), block).alias("i"), block.alias("j"), F.lit(1).alias("side"), "node", "m", "embedding").filter("i < j")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.unionByName(two).repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, held = [], [], 0
        for batch, start, stop in key_runs(batches, 3):
            part = batch.slice(start, stop - start)
            left = int(np.count_nonzero(part.column(3).to_numpy() == 0))
            ids, m = part.column(4).to_numpy(), part.column(5).to_numpy()
            unit = _unit(_matrix(part.column(6)))
            if part.column(1)[0].as_py() == part.column(2)[0].as_py():
                hit = unit @ unit.T >= MIN_COSINE
                np.fill_diagonal(hit, False)
                nodes.append(ids)
                links.append(hit @ m)
            else:
                hit = unit[:left] @ unit[left:].T >= MIN_COSINE
                nodes += [ids[:left], ids[left:]]
                links += [hit @ m[left:], m[:left] @ hit]
            held += stop - start
            if held > 20_000:
                yield pa.record_batch({"rep": np.concatenate(nodes), "others": np.concatenate(links)})
                nodes, links, held = [], [], 0
        if held:
            yield pa.record_batch({"rep": np.concatenate(nodes), "others": np.concatenate(links)})

    return dealt.mapInArrow(tidy(counted), "rep bigint, others bigint").groupBy("rep").agg(F.sum("others").alias("others"))


def assign(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept, a row per vector."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = v.withColumn("group_id", F.when(good, F.xxhash64("label", F.size("embedding"))))
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0.0 as 0.0
    usable = v.filter("group_id IS NOT NULL").select("vec_id", "group_id", plain.alias("embedding"))
    classes = cut(usable.groupBy("group_id", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "vector-classes")
    largest = classes.groupBy("group_id").count().agg(F.max("count")).first()[0] or 0
    bits, count = depth(largest), passes(largest)
    cells, crowded = _cells(classes, bits, count)
    pairs = [cut(_pass(classes, number, bits, crowded), "vector-pairs") for number in range(count)]
    if not crowded.isEmpty():
        pairs.append(cut(_crowded(classes, cells, crowded), "vector-pairs"))
    discard(cells, crowded)
    comp = cut(components(reduce(DataFrame.unionByName, pairs)), "vector-components")
    others = cut(_linked(classes, comp), "vector-links")
    discard(*pairs)
    summary = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(others, "rep", "left")
    summary = cut(summary.select("group_id", "embedding", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.col("m").alias("n")), "vector-summary")
    keyed = usable.withColumn("hash", F.xxhash64("group_id", "embedding"))
    cols = ["vec_id", "n_links", "component_id"]
    summary = summary.withColumn("hash", F.xxhash64("group_id", "embedding")).withColumnRenamed("embedding", "of").drop("group_id")
    discard(classes, comp, others)
    out = skew_join(keyed.select("hash", "vec_id", "embedding"), summary, "hash", v.count()).filter(F.col("embedding") == F.col("of")).select(*cols)
    alone = v.filter("group_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone).select(*cols, F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out.withColumnRenamed("vec_id", id_col)
