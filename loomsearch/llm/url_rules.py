"""URL rules by a sort-merge range join.

A host's labels are reversed (``a.example.net`` becomes ``net.example.a.``), so that a rule's host and all its
subdomains form one interval of keys, and the intervals nest. URLs are dealt to ranges of keys by boundaries sampled
from the URLs themselves; each rule goes to all ranges that its interval meets, so no side is broadcast. Each range is
sorted, and a sweep keeps a stack of the rule hosts that enclose the current key; the URL's path is then looked up
among the path prefixes of those hosts.

Equal keys (one host or one URL may hold a third of all rows) are spread over ranges by a hash of the row.

Defined cases: a null URL, or one without ``://``, has an empty host and path and meets no rule; no rule means
``DEFAULT_VERDICT``; of fitting rules the longest wins, among equally long ones that with the longest host; an empty
table gives an empty result; columns other than the id and the URL are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import listed, ship, tidy

DEFAULT_VERDICT = "allow"
#: Keys sampled for the boundaries of the ranges, per range.
SAMPLED = 64
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/ ? #``, lower-cased A-Z; then up to ``? #``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((i for i in range(end, len(rest)) if rest[i] in "?#"), len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


def host_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def interval(host: str) -> tuple[str, str]:
    """[low, high) of the keys of ``host`` and its subdomains: '/' follows '.'."""
    low = host_key(host)
    return low, low[:-1] + "/"


class Sweep:
    """Stack of nested rule hosts over ascending keys."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, tuple[str, str]]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key < self.stack[-1][1]:
            self.stack.pop()

    def enter(self, low: str, high: str, path: str, rule: str, verdict: str) -> None:
        self._leave(low)
        if not self.stack or self.stack[-1][0] != low:
            self.stack.append((low, high, {}))
        self.stack[-1][2].setdefault(path, (rule, verdict))

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self._leave(key)
        best: tuple[int, str, str] | None = None
        for _, _, paths in reversed(self.stack):  # the longest host first
            for size in sorted({len(p) for p in paths}, reverse=True):
                if (hit := paths.get(path[:size])) and len(path) >= size:
                    if best is None or len(hit[0]) > best[0]:
                        best = (len(hit[0]), *hit)
                    break
        return (best[1], best[2]) if best else (None, DEFAULT_VERDICT)


def _place(key: str, path: str, row: str) -> str:
    return f"{key}\x00{path}\x00{hashlib.md5(row.encode()).hexdigest()[:8]}"


def apply_rules(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """``rules``: (verdict, host, path). Returns id, host, path, rule, verdict, a row for each of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    id_type = base.schema["id"].dataType.simpleString()
    shape = f"bucket int, kind int, key string, high string, path string, rule string, verdict string, id {id_type}, host string"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                out.append(_place(host_key(host), path, str(i)))
            yield pa.record_batch({"place": pa.array(out, pa.string())})

    total = base.count()
    fraction = min(1.0, SAMPLED * n / max(total, 1))
    places = sorted(r.place for r in base.sample(fraction, seed=11).mapInArrow(keyed, "place string").collect())  # SAMPLED * n keys, about
    step = len(places) / n
    bounds = sorted({places[int(step * k)] for k in range(1, n)}) if len(places) >= n else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("bucket", "key", "path", "host")}
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                key = host_key(host)
                cols["bucket"].append(bisect.bisect_right(bounds, _place(key, path, str(i))))
                cols["key"].append(key)
                cols["path"].append(path)
                cols["host"].append(host)
            m = batch.num_rows
            none = pa.nulls(m, pa.string())
            yield pa.record_batch({
                "bucket": pa.array(cols["bucket"], pa.int32()), "kind": pa.array([1] * m, pa.int32()), "key": pa.array(cols["key"], pa.string()), "high": none,
                "path": pa.array(cols["path"], pa.string()), "rule": none, "verdict": none, "id": batch.column(0), "host": pa.array(cols["host"], pa.string())})

    # Each rule goes to every range that its interval meets.
    starts = []
    for verdict, host, path in rules:
        low, high = interval(host.translate(_LOWER))
        for b in range(bisect.bisect_right(bounds, low), bisect.bisect_left(bounds, high) + 1):
            starts.append((b, 0, low, high, path, f"{host}{path}", verdict, None, None))
    both = base.mapInArrow(tidy(dealt), shape).unionByName(listed(spark, starts, shape))
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "kind", "path")

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at = Sweep(), None
        for batch in batches:
            d = batch.to_pydict()
            pick, rule, verdict = [], [], []
            for k in range(batch.num_rows):
                if d["bucket"][k] != at:
                    sweep, at = Sweep(), d["bucket"][k]
                if d["kind"][k] == 0:
                    sweep.enter(d["key"][k], d["high"][k], d["path"][k], d["rule"][k], d["verdict"][k])
                else:
                    r, v = sweep.judge(d["key"][k], d["path"][k])
                    pick.append(k)
                    rule.append(r)
                    verdict.append(v)
            own = batch.take(pa.array(pick, pa.int64()))
            yield pa.record_batch({"id": own.column("id"), "host": own.column("host"), "path": own.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    return ordered.mapInArrow(tidy(swept), f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
