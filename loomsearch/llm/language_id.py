"""Language ID by cross-parsing entropy.

Per language, a suffix automaton of labelled passages is built. A text is parsed greedily into the longest phrases that
occur in the passages. A phrase costs the logarithm of the number of places that it can point to, so that a language
with less training text isn't at a disadvantage; the language whose phrases cost least wins.

The automaton is kept as a table (state, symbol) -> state whose sign tells that a phrase begins, so texts are parsed side
by side in array steps. A text is cut into windows of ``WINDOW`` symbols for this, each parsed as if a phrase began with
it; then the phrase that reaches over a window's border is followed until it begins a phrase where the window's own parse
does, from where both agree. The count is that of one greedy parse of the whole text.

Symbols are lower-cased letters that the training passages hold, one for any other letter, one for runs of the rest.
Training takes a bounded sample: about ``SAMPLE_DOCS`` distinct texts per language, chosen by a hash of the text, and of each
one passage of at most ``PASSAGE`` characters at a place given by the hash; ``TRAIN_CHARS`` bounds all languages together, and
the ``MAX_LANGS`` labels of the most rows (ties: code-point order) are learned. Only text and label are used, and only of rows that ``trainable`` selects.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every text is
``und``; ties go to the language first in code-point order; repeated rows get equal results and count once in training; a null label trains
nothing; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, ship, tidy
from .pretoken import groups

UNKNOWN = "und"
SAMPLE_DOCS, PASSAGE, TRAIN_CHARS = 96, 400, 160_000
MAX_LANGS = 200
#: Characters of texts that are parsed side by side.
CHARS = 250_000
WINDOW = 256
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, trainable: Column) -> dict[str, list[str]]:
    """Passages of each language, at most SAMPLE_DOCS * PASSAGE characters."""
    bits = 1 << 30
    rows = docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").withColumn("h", F.xxhash64("text"))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counted:
        return {}
    # A map of at most MAX_LANGS entries; copies of a text have one hash, so the share is of distinct texts.
    share = F.create_map(*(F.lit(x) for r in counted for x in (r.lang, min(1.0, 4 * SAMPLE_DOCS / r.texts))))
    picked = rows.filter(F.coalesce(F.pmod("h", F.lit(bits)) < share[F.col("lang")] * bits, F.lit(False)))
    room = F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1
    passage = F.substring(F.col("text"), (F.pmod(F.shiftright("h", 7), room.cast("bigint")) + 1).cast("int"), F.lit(PASSAGE))
    found = picked.select("lang", "h", passage.alias("passage")).groupBy("lang", "h").agg(F.min("passage").alias("passage")).collect()
    limit = TRAIN_CHARS // len(counted)
    by_lang: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h)):
        by_lang.setdefault(r.lang, []).append(r.passage)
    out: dict[str, list[str]] = {}
    for lang, passages in by_lang.items():
        size = 0
        for passage in passages[:SAMPLE_DOCS]:
            if size < limit and any(c.isalpha() for c in passage):
                out.setdefault(lang, []).append(passage[:limit - size])
                size += len(passage)
    return out


class Model:
    """The parse tables of all languages."""

    def __init__(self, passages: dict[str, list[str]]):
        self.langs = sorted(passages)
        seen = sorted({c for texts in passages.values() for t in texts for c in t.lower() if c.isalpha()})
        self.symbols = np.zeros(sys.maxunicode + 1, np.uint16)
        self.symbols[letters()] = 1  # a letter that training lacks
        self.symbols[[ord(c) for c in seen]] = np.arange(len(seen)) + 2
        self.pad = len(seen) + 2
        self.width = self.pad + 1
        coded = [[self.coded(t)[0] for t in passages[lang]] for lang in self.langs]
        self.tables = [self._table(texts) for texts in coded]
        #: Bits of a phrase: which place of the training text it points to.
        self.bits = np.array([np.log2(2 + sum(map(len, texts))) for texts in coded])

    def coded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a text with runs of non-letters as one, and which places of the text they come from."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep], np.flatnonzero(keep)

    def _table(self, texts: list[np.ndarray]) -> np.ndarray:
        """Suffix automaton of all passages (each starts anew at the root), as (states * width) targets; negative: a phrase begins."""
        go: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        for text in texts:
            last = 0
            for c in text.tolist():
                if c in go[last]:  # the generalised automaton: the state may be there from an earlier passage
                    q = go[last][c]
                    if size[q] == size[last] + 1:
                        last = q
                        continue
                    twin = len(go)
                    go.append(dict(go[q]))
                    size.append(size[last] + 1)
                    link.append(link[q])
                    link[q] = twin
                    p = last
                    while p != -1 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    last = twin
                    continue
                new = len(go)
                go.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in go[p]:
                    go[p][c] = new
                    p = link[p]
                if p != -1:
                    q = go[p][c]
                    if size[q] == size[p] + 1:
                        link[new] = q
                    else:
                        twin = len(go)
                        go.append(dict(go[q]))
                        size.append(size[p] + 1)
                        link.append(link[q])
                        link[q] = link[new] = twin
                        while p != -1 and go[p].get(c) == q:
                            go[p][c] = twin
                            p = link[p]
                last = new
        # One more state, for the start and for behind a symbol that the passages lack, which is a phrase of its own: whatever follows begins a phrase.
        root = np.full(self.width, len(go), np.int32)
        for c, q in go[0].items():
            root[c] = q
        table = np.tile(root * self.width - 2**30, (len(go) + 1, 1)).astype(np.int32)  # targets are kept times width
        for state, edges in enumerate(go):
            for c, q in edges.items():
                table[state, c] = q * self.width
        table[:, self.pad] = np.arange(len(go) + 1, dtype=np.int32) * self.width
        return table.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrases, and letters per text."""
        raw = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[self.lower()[cp]]
        owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (owner[1:] != owner[:-1])
        s, owner = s[keep], owner[keep]
        many = np.bincount(owner, minlength=len(texts))
        alpha = np.bincount(owner[s > 0], minlength=len(texts))
        windows = -(-many // WINDOW)
        of = np.repeat(np.arange(len(texts)), windows)
        first = np.cumsum(windows) - windows
        inside = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
        grid = np.full((int(windows.sum()), WINDOW), self.pad, np.uint16)
        grid[first[owner] + inside // WINDOW, inside % WINDOW] = s
        steps = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        borders = np.flatnonzero(of[1:] == of[:-1]) + 1  # windows that continue the one before
        for k, table in enumerate(self.tables):
            start = len(table) - self.width
            state = np.full(steps.shape[1], start, np.int32)
            begins = np.zeros(steps.shape, bool)
            for row, x in zip(begins, steps, strict=True):
                to = table[state + x]
                np.less(to, 0, out=row)
                state = to + (row.astype(np.int32) << 30)
            begun = begins.sum(axis=0, dtype=np.int64)
            if len(borders):
                self._stitch(table, grid, begins, state, begun, borders)
            out[:, k] = np.bincount(of, begun, len(texts))
        return out, alpha

    def _stitch(self, table: np.ndarray, grid: np.ndarray, begins: np.ndarray, state: np.ndarray, begun: np.ndarray, borders: np.ndarray) -> None:
        """Correct ``begun`` of the windows that continue another: follow the phrase at the border until the window's own parse begins one with it.

        All borders first take a few steps side by side, from the end of the window before, which is right if that window's parse was met;
        those that need more are followed one by one.
        """
        pad, big, steps = self.pad, 1 << 30, min(24, WINDOW)
        at, change = state[borders - 1].copy(), np.zeros(len(borders), np.int64)
        open_ = np.arange(len(borders))
        for k in range(steps):
            x = grid[borders[open_], k]
            to = table[at[open_] + x]
            new, own = to < 0, begins[k, borders[open_]]
            change[open_] += new.astype(np.int64) - own
            at[open_] = to + (new.astype(np.int32) << 30)
            open_ = open_[~(new & own) & (x != pad)]
            if not len(open_):
                break
        begun[borders] += change
        go = memoryview(table)
        late, redo = dict.fromkeys(borders[open_].tolist()), None
        at_of, change_of = dict(zip(borders[open_].tolist(), at[open_].tolist(), strict=True)), dict(zip(borders.tolist(), change.tolist(), strict=True)) if len(open_) else {}
        for w in sorted(late):
            if redo is not None and w < redo:
                continue  # followed already
            here, k, lead = at_of[w], steps, 0
            while True:
                own = begins[k:, w].tolist()
                met = False
                for x, b in zip(grid[w, k:].tolist(), own, strict=True):
                    if x == pad:
                        met = True  # the text ends
                        break
                    to = go[here + x]
                    lead -= b
                    if to < 0:
                        lead += 1
                        to += big
                        here = to
                        if b:
                            met = True
                            break
                    else:
                        here = to
                begun[w] += lead
                redo = w + 1
                if met or w + 1 not in change_of:
                    break
                # The next window was begun from a wrong place: again, from here.
                w, k, lead = w + 1, 0, -change_of[w + 1]

    _lower: np.ndarray | None = None

    def lower(self) -> np.ndarray:
        """Lower case of each code point, where it is one code point."""
        if Model._lower is None:
            single = lambda c, x: ord(x) if len(x) == 1 else c
            Model._lower = np.fromiter((single(c, chr(c).lower()) for c in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1)
        return Model._lower

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text. Score: the share by which the best language's cost is below the second's."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        whole = [t or "" for t in texts]
        for a, b in groups(whole, CHARS):
            phrases, alpha = self.phrases(whole[a:b])
            cost = phrases * self.bits
            best = cost.argmin(axis=1)
            for i in range(b - a):
                if not alpha[i]:
                    out.append((UNKNOWN, 0.0))
                elif len(self.langs) == 1:
                    out.append((self.langs[0], 1.0))
                else:
                    two = np.partition(cost[i], 1)[:2]
                    out.append((self.langs[best[i]], float(1 - two[0] / two[1])))
        return out


def held(passages: dict[str, list[str]]) -> Model:
    """This worker's model."""
    return hold(("language", *((k, *v) for k, v in sorted(passages.items()))), lambda: Model(passages))


def predict(docs: DataFrame, passages: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id (and the columns ``keep``), lang_pred, score per document."""
    ship(docs.sparkSession)
    base = docs.select(text_col, id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(passages)
        for batch in batches:
            found = model.predict(batch.column(0).to_pylist())
            yield pa.record_batch({name: batch.column(i + 1) for i, name in enumerate((id_col, *keep))} | {
                "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[1:])
    return base.mapInArrow(tidy(run), f"{shape}, lang_pred string, score double")


def keep_known(docs: DataFrame, passages: dict[str, list[str]]) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns, whatever their names."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(passages)
        for batch in batches:
            yield batch.filter(pa.array([x != UNKNOWN for x, _ in model.predict(batch.column(at).to_pylist())], pa.bool_()))

    return plain.mapInArrow(tidy(run), plain.schema).toDF(*names)
