"""MinHash near-dedup: banded minima find candidates, signatures and then full shingle sets confirm them, components follow.

Words are separated by ASCII white space, with A-Z lower-cased; a document's set holds the 64-bit hashes of its distinct
runs of five words (of all its words, if it has fewer). ``MINIMA`` universal hashes give a signature of minima.
Documents with equal words form a class, which is one node of the graph; its text is that of its least doc_id.

Candidates come in three rounds, so that no bucket of a band is expanded into all its pairs. First each bucket's nodes
are paired with its least one, then, in buckets that still hold several components, with the one whose signature agrees
most with the others'. Confirmed links are joined into components; a bucket whose nodes lie in one component can add
nothing. The nodes of all other buckets go through a prefix join across components: a node's shingles are put in
one order, rare ones first, and two sets that are similar enough share a shingle among the first few of both, how few follows from both
sizes. Smaller sets are listed by size class, so that a node meets only sizes that can link with it; the groups of
common shingles, known by their counts, are compared in blocks. Such pairs go through the signature test and are confirmed on full sets.
The threshold is a parameter; ``scheme`` cuts the signature into bands for it, so that a pair at the threshold is missed by the bands with probability 1e-6 at most, by the signature
test with 1e-5 at most; a pair that any band holds is lost only if its documents are joined by other links.

Defined cases: a null text, or one without words, has size 0 and links with nothing; a null doc_id links with nothing, its
component is null and it is kept; rows that repeat a doc_id are documents of their own, each with its own words, and of rows that repeat
both ``keep_one`` keeps one; an empty table gives an empty result; further columns are not read by ``assign`` and carried by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hold, ship, tidy
from .graph import components, skew_join
from .runs import key_runs

SHINGLE, MINIMA = 5, 120
#: Similarity of a link, in percent: of op10's contract, and where no contract sets one.
PERCENT, KEEP_PERCENT = 85, 80
#: Probabilities that the bands miss a pair at the threshold, and that the signature test drops it.
BAND_MISS, TEST_MISS = 1e-6, 1e-5
#: Nodes per block in the later rounds, and pairs of one node that share a copy of its set.
BLOCK, PER_SALT = 256, 256
#: Nodes up to which those whose sets are needed are broadcast (32 bytes each).
BROADCAST_IDS = 200_000
#: Shingles that count as common in the prefix join, at most; those of so few nodes never do. Size classes: each this much wider than the one before.
COMMON, RARE, CLASS_WIDTH = 100_000, 64, 1.02
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, MINIMA, np.uint64)
_C = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)


#: Words whose hash a worker keeps.
KNOWN_WORDS = 100_000


def scheme(percent: int) -> tuple[int, int]:
    """For a threshold: the minima of a band, as many as BAND_MISS allows, and how many equal minima a pair needs."""
    p = percent / 100
    rows = max((r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (1 - p**r) ** (MINIMA // r) <= BAND_MISS), default=1)
    need, below = 0, (1 - p) ** MINIMA
    while below <= TEST_MISS and need < MINIMA:
        need += 1
        below += comb(MINIMA, need) * p**need * (1 - p) ** (MINIMA - need)
    return rows, need


class _Words(dict):
    """Hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hold("words", _Words).__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    s = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        s += h[k:n - width + 1 + k] * _C[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 256):
        np.minimum(out, (_A[:, None] * s[None, k:k + 256] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """For each of the signatures one 64-bit key per band of so many minima, of them and its number."""
    x = sigs.reshape(len(sigs), -1, rows).astype(np.uint64)
    key = np.tile(np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (len(x), 1))
    for k in range(rows):
        key = (key ^ x[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def class_of(words: list[bytes]) -> bytes:
    """The class of a row of words: equal words, equal class."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls (of equal words), sig."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cls, sigs = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                s = shingles(words)
                size.append(len(s))
                cls.append(class_of(words) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array(size, pa.int64()), "cls": pa.array(cls, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return base.mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, cls binary, sig binary")


def _banded(sigs: DataFrame, percent: int) -> DataFrame:
    """node, key: a row per band of each node."""
    rows = scheme(percent)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, MINIMA)
                keys = band_keys(sig, rows)
                yield pa.record_batch({"node": np.repeat(batch.column(0).to_numpy(), keys.shape[1]), "key": keys.ravel()})

    return sigs.select("node", "sig").mapInArrow(run, "node bigint, key bigint")


def _agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree well enough."""
    need = scheme(percent)[1]
    total = pairs.count()
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    of_a = cut(many.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a"), "near-leaders")
    both = skew_join(pairs, of_a, "a", total).join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in (2, 3))
            ok = (x == y).sum(axis=1) >= need
            yield batch.select([0, 1]).filter(pa.array(ok))

    out = cut(both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint"), "near-pairs")
    discard(of_a)
    return out


def _sets(docs: DataFrame, nodes: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (array of bigint) of the chosen nodes, from the text of each one's representative. reps: node, doc_id, cls."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = cut(reps.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi").select("doc_id", "node", "cls"), "near-wanted")
    chosen = base.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("node", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(2)]
            same = np.array([class_of(w) == c for w, c in zip(words, batch.column(1).to_pylist(), strict=True)], bool)  # a doc_id may repeat with other words
            yield pa.record_batch({"node": batch.column(0).filter(pa.array(same)), "shingles": pa.array([shingles(w).view(np.int64) for w, ok in zip(words, same, strict=True) if ok], pa.list_(pa.int64()))})

    return chosen.mapInArrow(tidy(run), "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, whose full sets are similar enough. A copy of a's set serves PER_SALT pairs at most."""
    total = pairs.count()
    if not total:
        return pairs
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ids")
    sets = cut(_sets(docs, nodes, reps, id_col, text_col), "near-sets")
    many = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-degrees").withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("bigint"))
    salted = skew_join(pairs, many, "a", total).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    left = sets.join(many.select(F.col("a").alias("node"), "salts"), "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("set_a"))
    both = right.join(left, ["a", "salt"]).withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    out = cut(both.filter(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("a", "b"), "near-links")
    discard(pairs, nodes, sets)
    return out


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, node, component, size: the members of buckets that hold several components. members: key, node, of buckets of 3 or more."""
    placed = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed, "near-placed")
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most")).filter("most < n").drop("most")
    mixed = cut(mixed, "near-mixed")
    out = cut(skew_join(placed, mixed.withColumn("size", F.col("n")), "key", placed.count()), "near-open")
    discard(placed, mixed)
    return out


def _central(open_: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): each open bucket's nodes with the one whose signature agrees most with those of its block."""
    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = open_.withColumn("i", F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("size") / BLOCK).cast("bigint"))).join(sigs, "node").select("key", "i", "node", "sig")
    dealt = dealt.repartition(n, "key", "i").sortWithinPartitions("key", "i", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, score = [], [], []
        for batch, start, stop in key_runs(batches, 2):
            part = batch.slice(start, stop - start)
            sig = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint32).reshape(-1, MINIMA)
            agree = np.array([(sig == x).sum() for x in sig])
            best = int(agree.argmax())
            keys.append(part.column(0)[0].as_py())
            ids.append(part.column(2)[best].as_py())
            score.append(float(agree[best]) / len(sig))
            if len(keys) >= 10_000:
                yield pa.record_batch({"key": keys, "a": ids, "score": score})
                keys, ids, score = [], [], []
        if keys:
            yield pa.record_batch({"key": keys, "a": ids, "score": score})

    best = dealt.mapInArrow(run, "key bigint, a bigint, score double").groupBy("key").agg(F.max(F.struct("score", "a"))["a"].alias("a"))
    counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = cut(best.join(counts, "key"), "near-central")
    pairs = skew_join(open_.select("key", "node"), best, "key", open_.count()).filter("node <> a")
    out = cut(pairs.select(F.least("a", "node").alias("x"), F.greatest("a", "node").alias("y"), "a", F.col("node").alias("b")).dropDuplicates(["x", "y"]).select("a", "b"), "near-second")
    discard(best)
    return out


def _overlap(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes have in common at least, if they are similar enough."""
    return -(-(x + y) * percent // (100 + percent))


def _common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many of the sets, in ascending order, and of how many: at most COMMON of them, as the counts add up to the total."""
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") > max(RARE, total // COMMON)).collect()  # COMMON rows at most
    found.sort()
    return np.array([r.s for r in found], np.int64), np.array([r.n for r in found], np.int64)


def _prefix_rows(shingle: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(key, blocks, role, pos) of one set: what it is listed under as the smaller set of a pair (role 1) and looks up as the larger one (role 0).

    A key is of a shingle and a size class; blocks: of the shingle, by its count; pos: the shingle's place in the set's order, from 1.
    """
    n = len(shingle)
    at = np.searchsorted(common, shingle)
    at[at == len(common)] = 0
    often = np.where(common[at] == shingle, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    order = np.lexsort((shingle, often))
    size_class = lambda m: np.floor(np.log(np.maximum(m, 1)) / np.log(CLASS_WIDTH) + 1e-9).astype(np.int64)
    lowest = -(-n * percent // 100)  # of the smaller set
    longest = n - lowest + 1
    own = min(n, int(n - _overlap(np.int64(n), np.int64(n), percent) + 1))
    token, often = shingle[order[:longest]], often[order[:longest]]
    pos = np.arange(1, len(token) + 1)
    # As the larger set: a place pos allows smaller sets whose overlap leaves it in the prefix.
    reach = np.minimum(n, (n - pos + 1) * (100 + percent) // percent - n)
    classes = np.arange(size_class(lowest), size_class(n) + 1)
    top = np.where(reach >= lowest, size_class(reach), -1)
    look = classes[None, :] <= top[:, None]
    where, cls = np.nonzero(look)
    tokens = np.concatenate([token[where], token[:own]])
    cls = np.concatenate([classes[cls], np.full(own, size_class(n))])
    key = (tokens.view(np.uint64) ^ (cls.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    every = np.concatenate([often[where], often[:own]])
    return key.view(np.int64), np.maximum(1, -(-every // BLOCK)), np.repeat([0, 1], [len(where), own]), np.concatenate([pos[where], pos[:own]])


def _across(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a < b, of sets (node, component, shingles) whose components differ and which may be similar enough, by a prefix join."""
    common, counts = _common_shingles(sets)
    shape = "key bigint, i bigint, j bigint, role int, pos int, node bigint, component bigint, size int"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            held = 0
            for node, comp, shingle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = shingle.values.to_numpy()
                key, blocks, role, pos = _prefix_rows(x, common, counts, percent)
                # A pair meets in one block: the larger set's row i is its own and j any, the smaller set's the other way round.
                row = np.repeat(np.arange(len(key)), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = ((node * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33) % blocks[row]
                larger = role[row] == 0
                for o, v in zip(out, (key[row], np.where(larger, mine, other), np.where(larger, other, mine), role[row], pos[row], np.full(len(row), node), np.full(len(row), comp), np.full(len(row), len(x))), strict=True):
                    o.append(v)
                held += len(row)
                if held > 20_000:
                    yield _batch(out)
                    out, held = [[] for _ in range(8)], 0
            if held:
                yield _batch(out)

    def _batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        names = [c.split()[0] for c in shape.split(", ")]
        return pa.record_batch([pa.array(np.concatenate(o), t) for o, t in zip(out, types, strict=True)], names)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select("node", "component", "shingles").mapInArrow(tidy(listed), shape).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held, last = [], [], 0, None
        for batch, start, stop in key_runs(batches, 3):
            if stop - start < 2:
                continue
            if batch is not last:
                last = batch
                role, pos, node, comp, size = (batch.column(c).to_numpy().astype(np.int64) for c in range(3, 8))
            split = start + int(np.searchsorted(role[start:stop], 1))
            if split == start or split == stop:
                continue
            y = slice(split, stop)
            for r in range(start, split):
                need = _overlap(size[r], size[y], percent)
                hit = (size[y] <= size[r]) & (comp[y] != comp[r]) & (pos[r] <= size[r] - need + 1) & (pos[y] <= size[y] - need + 1)
                at = split + np.flatnonzero(hit)
                if len(at):
                    a.append(np.minimum(node[at], node[r]))
                    b.append(np.maximum(node[at], node[r]))
                    held += len(at)
            if held > 20_000:
                yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b, held = [], [], 0
        if held:
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _classed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, of_class): doc_id, n_shingles, cls per row of ``docs``, and a row per class: cls, rep (its least doc_id), component_id, leads (its component's least), n."""
    sketches = cut(sketch(docs, id_col, text_col), "near-sketches")
    known = sketches.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    rows = cut(sketches.drop("sig"), "near-rows")
    discard(sketches)
    reps, sigs = classes.select("node", F.col("rep").alias("doc_id"), "cls"), classes.select("node", "sig")
    banded = _banded(sigs, percent)
    buckets = cut(banded.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    members = cut(skew_join(banded, buckets.withColumn("size", F.col("n")), "key", classes.count() * (MINIMA // scheme(percent)[0])), "near-members")
    first = cut(members.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "near-first")
    links = _confirmed(docs, _agreeing(first, sigs, percent), reps, id_col, text_col, percent)
    comp = cut(components(links), "near-components")
    wide = cut(members.filter("size > 2").select("key", "node"), "near-wide")
    discard(members, buckets)
    open_ = _mixed(wide, comp)
    discard(wide)
    if not open_.isEmpty():
        second = _central(open_, sigs)
        more = _confirmed(docs, _agreeing(second.join(first, ["a", "b"], "left_anti"), sigs, percent), reps, id_col, text_col, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            before, comp = (open_, comp), cut(components(links), "near-components")
            open_ = _mixed(open_.select("key", "node"), comp)
            discard(*before)
        placed = cut(open_.select("node", "component").distinct(), "near-open-nodes")
        sets = cut(_sets(docs, placed.select("node"), reps, id_col, text_col).join(placed, "node"), "near-open-sets")
        done = first.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        third = cut(_across(sets, percent).join(done, ["a", "b"], "left_anti"), "near-third")
        late = _confirmed(docs, _agreeing(third, sigs, percent), reps, id_col, text_col, percent)
        if not late.isEmpty():
            comp = cut(components(links.unionByName(late)), "near-components")
        discard(second, placed, sets, third)
    discard(open_, first)
    nodes = classes.select("cls", "rep", "n", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes, "near-nodes")
    heads = cut(nodes.groupBy("component").agg(F.min(F.struct("rep", "cls")).alias("head"), F.count(F.lit(1)).alias("n")), "near-heads")
    of_class = skew_join(nodes.withColumnRenamed("n", "rows"), heads, "component", nodes.count())
    of_class = cut(of_class.select("cls", "rep", F.col("head.rep").alias("component_id"), (F.col("head.cls") == F.col("cls")).alias("leads"), F.col("rows").alias("n")), "near-of-class")
    discard(classes, links, comp, nodes, heads)
    return rows, of_class


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row per document; documents link from a similarity of ``percent`` on."""
    rows, of_class = _classed(docs, id_col, text_col, percent)
    known = rows.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    found = skew_join(known, of_class, "cls", known.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("cls IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, with its least doc_id, and all rows without words or id.

    Rows are told apart by id and words, so that rows that share an id with a copy stay. Of rows that agree in both, one stays (that with the least text; of equal rows any).
    """
    rows, of_class = _classed(docs, "doc_id", "text", percent)
    known = rows.filter("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("times"))
    known = cut(known, "near-known")
    placed = skew_join(known, of_class, "cls", known.count())
    marked = cut(placed.select(F.col("doc_id").alias("__loom_id"), F.col("cls").alias("__loom_cls"), (F.col("leads") & (F.col("doc_id") == F.col("rep"))).alias("stays"), "times"), "near-marked")
    discard(known, of_class)
    gone = marked.filter("not stays or times > 1")
    ids = cut(gone.select(F.col("__loom_id")).distinct(), "near-gone")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    mine = F.col("__id") == F.col("__loom_id")
    plain = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("__id"), F.col("text").alias("__text"))
    untouched = plain.join(small, mine, "left_anti").select("row")
    repeated = rows.select(F.col("doc_id").alias("__id")).join(small, mine, "left_semi").groupBy("__id").count().filter("count > 1")
    if repeated.isEmpty():  # every such id is one row, which goes
        return untouched.select("row.*")
    joined = with_class(plain.join(small, mine, "left_semi")).join(gone, mine & F.col("__cls").eqNullSafe(F.col("__loom_cls")), "left")
    single = joined.filter("__loom_id IS NULL").select("row")
    twice = joined.filter("stays and times > 1").groupBy("__id", "__cls").agg(F.min_by("row", "__text").alias("row")).select("row")
    return untouched.unionByName(single).unionByName(twice).select("row.*")


def with_class(rows: DataFrame) -> DataFrame:
    """``rows`` with the column __cls, of their column __text."""

    @F.arrow_udf("binary")
    def cls(texts: pa.Array) -> pa.Array:
        return pa.array([class_of(w) if (w := words_of(t)) else None for t in texts.to_pylist()], pa.binary())

    return rows.withColumn("__cls", cls("__text"))
