"""Secret scan: three fixed patterns, and values in a credential's context whose guess cost is high.

The guess cost of a value is the cheapest way to write it as a row of segments, in bits (log2 of the guesses that an
attacker who knows the segment kinds needs): dictionary words (in any case, with digits for letters), signs between words, dates, repeats of
a short unit, walks over a keyboard or the alphabet, and brute-force spans. It is the minimum over all segmentations, found by dynamic programming over the
end of the last segment; walks and repeats may start and end anywhere in a run. Words are the few of ``WORDS``, then the words and word pieces of the byte-level vocabulary in its
order, so prose, ``correct`` words and ``qwerty123`` are cheap and random strings are not, with or without digits. Only
a value that is one template as a whole (``${NAME}``, ``{{name}}``, ``<name>``, ``%NAME%``) is left alone. Values count if a word such as ``password``, ``pwd`` or ``passphrase`` precedes them.

Defined cases: a null or empty text has no spans; repeated rows each get their own result; a null doc_id is carried;
an empty table gives an empty result; further columns are not read. Memory is linear in the text's length, time too but
for a value's longest run, whose length counts with its logarithm.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, tidy

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What introduces a value of the method: a credential's name, also as the end of a longer one (DB_PWD), then a sign or "is";
#: or the scheme of an Authorization header and a space; then the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?ai:pass(?:word|wd|phrase|code)|pwd|secret(?:[_-]key)?|token|api_?key|credentials?|bearer|auth(?:orization)?|private[_-]?key|client_secret|pin)"""
    r"""["']?(?:\x20*+(?::|=>?)|\x20++(?ai:is)\x20)\x20*+["']?|(?ai:bearer|basic)\x20++["']?)([^\s"'<>,;]{8,})""")
HINTS = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"bearer", b"basic", b"auth", b"private", b"pin")
#: A value counts from this cost on, in bits.
MIN_BITS = 40.0

WORDS = """password secret admin welcome login letmein master dragon monkey shadow sunshine princess football baseball
superman batman trustno hello freedom whatever access love money server system user guest root test demo example sample
default change changeme please enter your here value string token key auth service client public private database data
correct horse battery staple summer winter spring autumn orange apple banana coffee company secure account email phone
number name word pass code open close start stop this that with from have will should must never always none null true
false undefined placeholder redacted hidden unknown required optional""".split()
#: Letters of a word at most.
LONGEST = 24


def vocabulary() -> list[str]:
    """Lower-cased words and pieces of words of the byte-level vocabulary, in the order of its merges."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        words = [base64.b64decode(line.split()[0]).strip().lower().decode("utf-8", "ignore") for line in f if line.strip()]
    return [w for w in words if 3 <= len(w) <= LONGEST and w.isalpha()]


RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *vocabulary()]))}
#: A sign between words.
JOINS, JOIN_BITS = frozenset("-_./"), 2.0
TEMPLATE = re.compile(r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|<[^<>]*>|%\w+%")
LEET = str.maketrans("0134578@$!", "oleastbasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b): (n, 1) for n, row in enumerate(ROWS) for a, b in zip(row, row[1:], strict=False)} | {(b, a): (n, -1) for n, row in enumerate(ROWS) for a, b in zip(row, row[1:], strict=False)}
#: Columns of the keyboard, walked down or up: q-a-z.
for _x in zip("1234567890", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./", strict=True):
    for _a, _b in zip(_x, _x[1:], strict=False):
        NEXT |= {(_a, _b): (9, 1), (_b, _a): (9, -1)}
DATE = re.compile(r"(?a)(?:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
SEGMENT_BITS = 1.0  # for where a segment ends
DATE_BITS, YEAR_BITS = math.log2(365 * 130), math.log2(130)
#: A walk: where it starts, and each change of its direction; letters at least.
WALK_BITS, TURN_BITS, WALK_LEAST = math.log2(47), 2.0, 3
#: A repeat: letters of its unit at most, letters of all at least.
UNIT, REPEAT_LEAST = 4, 3
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _char_bits(c: str) -> float:
    if "0" <= c <= "9":
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(100)


def word_bits(part: str) -> float:
    """Of a dictionary word, else infinite."""
    low = part.translate(_LOW)
    rank = RANK.get(low) or RANK.get(low.translate(LEET))
    return math.log2(rank + 1) + (part != low) * 2 + (low not in RANK) * 2 if rank and 3 <= len(part) <= LONGEST else math.inf


def date_bits(part: str) -> float:
    return math.inf if len(part) not in (4, 8, 10) or not DATE.fullmatch(part) else YEAR_BITS if len(part) == 4 else DATE_BITS


def length_bits(letters: int) -> int:
    """Of a walk or a repeat: which power of two its length reaches."""
    return letters.bit_length() - 1


class _Run:
    """Least cost of starting a segment of at least ``least`` letters somewhere in the current run, with the bits of its length.

    Starts of one length class form a window that slides along the run; each class keeps its minimum in a queue.
    """

    def __init__(self, least: int):
        self.least = least
        self.queues: list[deque[tuple[float, int]]] = []

    def clear(self) -> None:
        self.queues = []

    def best(self, i: int, first: int, cost: Callable[[int], float]) -> float:
        """The minimum over starts j from ``first`` to i - least of cost(j) and the length's bits; called for each i of the run, in order."""
        if not self.queues and i - first >= self.least:
            self.queues = [deque() for _ in range(length_bits(self.least))]
        out = math.inf
        if i - first < self.least:
            return out
        while length_bits(i - first) >= len(self.queues):
            self.queues.append(deque())
        for c in range(length_bits(self.least), len(self.queues)):
            low = max(self.least, 1 << c)
            queue, j = self.queues[c], i - low
            if j >= first:
                x = cost(j)
                while queue and queue[-1][0] >= x:
                    queue.pop()
                queue.append((x, j))
            while queue and i - queue[0][1] >= 2 << c:
                queue.popleft()
            if queue:
                out = min(out, queue[0][0] + c)
        return out


def guess_bits(value: str) -> float:
    """The cheapest segmentation's cost."""
    n = len(value)
    if not n:
        return 0.0
    low = value.translate(_LOW)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # the cheapest whose last segment is a brute-force span
    walk = 1  # letters of the walk that ends here
    turns = [0] * (n + 1)  # changes of direction among the letters before here, in the current walk
    walks, repeats, period = _Run(WALK_LEAST), [_Run(max(2 * p, REPEAT_LEAST)) for p in range(UNIT + 1)], [0] * (UNIT + 1)
    for i in range(1, n + 1):
        brute = min(brute, best[i - 1] + SEGMENT_BITS) + _char_bits(value[i - 1])
        cost = brute
        if value[i - 1] in JOINS:
            cost = min(cost, best[i - 1] + SEGMENT_BITS + JOIN_BITS)
        for j in range(max(0, i - LONGEST), i - 2):
            rank = RANK.get(low[j:i]) or RANK.get(plain[j:i])
            if rank:
                extra = (value[j:i] != low[j:i]) * 2 + (low[j:i] not in RANK) * 2
                cost = min(cost, best[j] + SEGMENT_BITS + math.log2(rank + 1) + extra)
        if "0" <= value[i - 1] <= "9":
            for j in (i - 4, i - 8, i - 10):
                if j >= 0 and "0" <= value[j] <= "3":
                    cost = min(cost, best[j] + SEGMENT_BITS + date_bits(value[j:i]))
        if i > 1:
            step = NEXT.get((low[i - 2], low[i - 1]))
            if step:
                turn = walk > 1 and step != NEXT[low[i - 3], low[i - 2]]
                walk, turns[i] = walk + 1, turns[i - 1] + turn
                # From start j on, only changes behind its second letter count.
                cost = min(cost, walks.best(i, i - walk, lambda j: best[j] - TURN_BITS * turns[j + 2]) + SEGMENT_BITS + WALK_BITS + TURN_BITS * turns[i])
            else:
                walk = 1
                walks.clear()
            for p in range(1, UNIT + 1):
                if i > p and value[i - 1] == value[i - 1 - p]:
                    period[p] += 1
                    found = repeats[p].best(i, i - period[p] - p, best.__getitem__)
                    if found < math.inf:  # any p letters of the run are its unit
                        cost = min(cost, found + SEGMENT_BITS + sum(map(_char_bits, value[i - p:i])))
                elif period[p]:
                    period[p] = 0
                    repeats[p].clear()
        best[i] = cost
    return best[n]


def is_secret(value: str) -> bool:
    """A high guess cost, and not a template as a whole."""
    return not TEMPLATE.fullmatch(value) and guess_bits(value) >= MIN_BITS


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three fixed patterns, whole matches, in the order of start, then kind."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(k in raw for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def guess_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Values in a credential's context with a high guess cost that no base span meets. ``base`` ascends by start."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if not any(h in raw for h in HINTS):
        return []
    starts, reach, most = [], [], 0
    for _, s, e in base:
        most = max(most, e)
        starts.append(s)
        reach.append(most)  # the furthest end of the spans so far
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".:)]!?":
            end -= 1
        before = bisect_right(starts, end - 1)  # spans that start before the value ends
        if end - start >= 8 and not (before and reach[before - 1] > start) and is_secret(text[start:end]):
            out.append(("guess", start, end))
    return out


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text or "")
    return base, sorted(base + guess_spans(text or "", base), key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans: arrays of (kind, start, end) per document."""
    ship(docs.sparkSession)
    base = docs.select(id_col, text_col)
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({id_col: batch.column(0), "base": pa.array([named(b) for b, _ in found], struct), "spans": pa.array([named(s) for _, s in found], struct)})

    return base.mapInArrow(tidy(run), f"`{id_col}` {base.schema[0].dataType.simpleString()}, base {kind}, spans {kind}")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
