"""Byte-level BPE by DuckDB queries inside each partition.

A merge table lists every pair of tokens whose bytes together are a token, with that token's rank. The distinct words of
some texts become rows (word, position, token); a recursive query joins neighbours with the merge table and contracts
each word's leftmost minimum-rank pair until no pair is left. Decoding is an ordered aggregation of the tokens' bytes.

A word of over ``WINDOW`` bytes enters the same recursion as windows that overlap by half. Two windows are joined where
both begin the same token at the same byte, so every two neighbours of the joined row stand side by side in the code of
some window. For the ranks of a trained BPE (each token splits into two of lower rank, which is checked), a row of tokens is a text's code exactly
if each two neighbours are the code of their own bytes, so the joined row is the word's code. Where two windows share no such place, as in runs of one
unit, they become one, whose code ``STEP`` finds by contracting all occurrences of the minimum pair at once, from left to
right, in steps whose rows aren't kept; such text has few kinds of pairs, so few steps.

Defined cases: a null text counts as empty and has no ids; repeated rows each get their own result; a null doc_id is
carried; an empty table gives an empty result; further columns are not read; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hold, ship, tidy
from .pretoken import Encoder, groups

#: Bytes of a window of a longer word, and from one window's start to the next one's.
WINDOW, STRIDE = 64, 32
#: Rows that a recursive query makes over all its steps, and tokens per decoding query, which bound its memory.
ROWS_PER_QUERY, TOKENS_PER_QUERY = 1_000_000, 100_000
#: Bound of DuckDB's memory in a worker (a query of so many rows takes some 100 MB), and while it codes a run that windows can't be joined in.
MEMORY, MEMORY_RUNS = "256MB", "1GB"
#: Characters of texts that are encoded and decoded at once.
CHARS = 800_000

#: One step of the loop over words(w, pos, tok): all occurrences of the least pair. Positions of a word count from 1 without gaps.
STEP = """
  SELECT w, row_number() OVER (PARTITION BY w ORDER BY pos) AS pos, coalesce(made, tok) AS tok
  FROM (
    SELECT w, pos, tok, CASE WHEN take THEN merged END AS made, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
    FROM (
      SELECT w, pos, tok, merged,
             hit AND (pos - max(CASE WHEN NOT hit THEN pos ELSE 0 END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS take
      FROM (
        SELECT w, pos, tok, merged, coalesce(merged = min(merged) OVER (PARTITION BY w), false) AS hit, min(merged) OVER (PARTITION BY w) AS least
        FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS follower FROM words) p
        LEFT JOIN merges m ON m.a = p.tok AND m.b = p.follower
      ) WHERE least IS NOT NULL
    )
  ) WHERE NOT eaten
"""
#: All steps over words(w, pos, tok): neighbours, their least rank and where it comes first, one contraction.
RECURSIVE = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM words
  UNION ALL
  (WITH pairs AS (SELECT w, pos, tok, step, lead(tok) OVER (ORDER BY w, pos) AS follower, lead(pos) OVER (ORDER BY w, pos) AS after FROM t),
        least AS (SELECT p.w, min(m.merged * 4096::BIGINT + p.pos) AS k, arg_min(p.after, m.merged * 4096::BIGINT + p.pos) AS eaten
                  FROM pairs p JOIN merges m ON m.a = p.tok AND m.b = p.follower WHERE p.after > p.pos GROUP BY p.w)
   SELECT p.w, p.pos, CASE WHEN p.pos = k % 4096 THEN (k // 4096)::INTEGER ELSE p.tok END, p.step + 1
   FROM pairs p JOIN least USING (w) WHERE p.pos <> eaten)
), ended AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT w, pos, tok FROM t JOIN ended USING (w, step) ORDER BY w, pos"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, merged) for every split of a token into two tokens. Raises if a token has no split into two of lower rank, as then its ranks are no merges."""
    a, b, merged = [], [], []
    for token, rank in ranks.items():
        made = len(token) == 1
        for k in range(1, len(token)):
            x, y = ranks.get(token[:k]), ranks.get(token[k:])
            if x is not None and y is not None:
                a.append(x)
                b.append(y)
                merged.append(rank)
                made = made or (x < rank and y < rank)
        if not made:
            raise ValueError(f"no merge makes token {rank}")
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32())})


class DuckBpe:
    """One DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, rank_file: str):
        import duckdb

        self.ranks = read_ranks(rank_file)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.size[rank] = len(token)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", merge_table(self.ranks))
        # Bytes as characters of the same number, which a string aggregate joins.
        self._table("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())}))
        self.encoder = Encoder(self.words)

    def _do(self, sql: str) -> list[tuple]:
        return self.db.execute(sql).fetchall()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self._do(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _rows(self, words: list[bytes]) -> pa.Table:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table({"w": w, "pos": np.arange(len(tok)) - np.repeat(start, size) + 1, "tok": tok})

    def _recursed(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most WINDOW bytes."""
        out: list[list[int]] = []
        at = 0
        while at < len(words):
            to, rows = at, 0
            while to < len(words) and rows < ROWS_PER_QUERY:
                rows += len(words[to]) * (len(words[to]) + 3) // 2
                to += 1
            self._table("words", self._rows(words[at:to]))
            out += self._collect(self.db.sql(RECURSIVE).to_arrow_table(), to - at)
            at = to
        return out

    def _stepped(self, word: bytes) -> list[int]:
        """Ids of a word of any length, step by step."""
        self._do(f"SET memory_limit = '{MEMORY_RUNS}'")
        self._table("words", self._rows([word]))
        left = len(word)
        while True:
            self._do(f"CREATE OR REPLACE TABLE later AS {STEP}")
            now = self._do("SELECT count(*) FROM later")[0][0]
            if not now or now == left:
                break
            self._do("DROP TABLE words")
            self._do("ALTER TABLE later RENAME TO words")
            left = now
        out = self._collect(self.db.sql("SELECT w, pos, tok FROM words ORDER BY w, pos").to_arrow_table(), 1)[0]
        self._do("DROP TABLE words")
        self._do("DROP TABLE IF EXISTS later")
        self._do(f"SET memory_limit = '{MEMORY}'")
        return out

    @staticmethod
    def _collect(rows: pa.Table, count: int) -> list[list[int]]:
        cuts = np.searchsorted(rows["w"].to_numpy(), np.arange(count + 1)).tolist()
        flat = rows["tok"].to_numpy().tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _meeting(self, left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, int] | None:
        """(i, j): the first tokens of two windows (start, ids) that are one token at one byte, in a place that both hold."""
        (at, x), (b, y) = left, right
        size, i, j, a = self.size, 0, 0, at
        while i < len(x) and j < len(y):
            if a == b:
                if x[i] == y[j]:
                    return i, j
                a += int(size[x[i]])
                i += 1
            elif a < b:
                a += int(size[x[i]])
                i += 1
            else:
                b += int(size[y[j]])
                j += 1
        return None

    def _joined(self, word: bytes, windows: list[tuple[int, list[int]]]) -> list[int]:
        """Ids of a word from those of its windows (start, ids)."""
        while True:
            meets = [self._meeting(x, y) for x, y in zip(windows, windows[1:], strict=False)]
            if None not in meets:
                break
            merged: list[tuple[int, list[int]]] = []
            k = 0
            while k < len(windows):
                end = k
                while end < len(meets) and meets[end] is None:
                    end += 1
                if end > k:
                    stop = windows[end][0] + int(self.size[windows[end][1]].sum())
                    merged.append((windows[k][0], self._stepped(word[windows[k][0]:stop])))
                else:
                    merged.append(windows[k])
                k = end + 1
            windows = merged
        out: list[int] = []
        begin = 0
        for (_, ids), meet in zip(windows, [*meets, None], strict=True):
            out += ids[begin:meet[0]] if meet else ids[begin:]
            begin = meet[1] if meet else 0
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. A word that is a token itself is that token, as in the library."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[r] if (r := self.ranks.get(x)) is not None else [] for x in raw]
        rows: list[tuple[int, int, int]] = []
        for i, x in enumerate(raw):
            if not out[i] and x:
                n = len(x)
                rows += [(i, a, min(a + WINDOW, n)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]
        ids = self._recursed([raw[i][a:b] for i, a, b in rows])
        k = 0
        while k < len(rows):
            i, end = rows[k][0], k + 1
            while end < len(rows) and rows[end][0] == i:
                end += 1
            out[i] = ids[k] if end == k + 1 else self._joined(raw[i], [(rows[m][1], ids[m]) for m in range(k, end)])
            k = end
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation; a long list runs in pieces."""
        out: list[list[bytes]] = [[] for _ in ids]
        todo: list[tuple[int, np.ndarray]] = [(i, x[k:k + TOKENS_PER_QUERY]) for i, x in enumerate(ids) for k in range(0, len(x), TOKENS_PER_QUERY)]
        at = 0
        while at < len(todo):
            to, size = at, 0
            while to < len(todo) and (to == at or size + len(todo[to][1]) <= TOKENS_PER_QUERY):
                size += len(todo[to][1])
                to += 1
            part = todo[at:to]
            doc = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for _, x in part])
            self.db.register("ids", pa.table({"d": doc, "pos": np.arange(size, dtype=np.int32), "tok": np.concatenate([x for _, x in part]).astype(np.int32)}))
            rows = self._do("SELECT d, string_agg(bytes, '' ORDER BY pos) AS joined FROM ids JOIN vocabulary USING (tok) GROUP BY d")
            self.db.unregister("ids")
            for d, joined in sorted(rows):
                out[part[d][0]].append(joined.encode("latin-1"))
            at = to
        return [b"".join(x) for x in out]


def held(rank_file: str) -> DuckBpe:
    """This worker's encoder."""
    return hold(("bpe", rank_file), lambda: DuckBpe(rank_file))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in slices of about CHARS characters, with the texts of column ``at``."""
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in groups(texts, CHARS):
            yield batch.slice(a, b - a), texts[a:b]


def encode_decode(docs: DataFrame, rank_file: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, ids (array of int) and decoded (binary) per document."""
    ship(docs.sparkSession)
    base = docs.select(text_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(rank_file)
        for part, texts in _parts(batches, 0):
            ids = bpe.encode(texts)
            lengths = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.record_batch({name: part.column(i + 1) for i, name in enumerate(keep)} | {
                "n_tokens": pa.array(np.diff(lengths).astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                "decoded": pa.array(bpe.decode(ids), pa.binary())})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[1:])
    return base.mapInArrow(tidy(run), f"{shape}, n_tokens bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers), decoded_sha256: as ``encode_decode``, without sending ids to the JVM."""
    ship(docs.sparkSession)
    base = docs.select(id_col, text_col)
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(rank_file)
        for part, texts in _parts(batches, 1):
            ids = bpe.encode(texts)
            yield pa.record_batch({
                id_col: part.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([digest(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids], pa.string()),
                "decoded_sha256": pa.array([digest(b) for b in bpe.decode(ids)], pa.string())})

    return base.mapInArrow(tidy(run), f"`{id_col}` {base.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
