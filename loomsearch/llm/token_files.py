"""Token ids as Arrow files of equal-length sequences with masks.

Each file of a data set is an Arrow IPC file whose record batches hold two fixed-size lists per row: ``tokens`` (of
``LENGTH`` ids, of 16 bits where the vocabulary allows it) and ``mask`` (of LENGTH / 8 bytes, a bit per id, lowest first: 1 token, 0 padding). Batches have ``ROWS``
rows, so row i is in batch i // ROWS, and a memory-mapped file gives any sequence and its mask without a copy. Documents
follow one another across sequences; only the end of a file is padded. Beside it lies a file of the documents: id, first
token in the file, number of tokens. Files are numbered in ascending order of doc_id.

A task writes under a name of its own and moves the files into place when they are whole, so a task that is lost or run
twice leaves nothing that is read.

Defined cases: a null or empty text is its end id alone; null ids come first; equal ids are ordered by a hash of the text; repeated
rows each get their own span; an empty table gives no file and an empty result; further columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hold, listed, open_fs, ship, tidy
from .pretoken import Encoder, PackedPieces, groups

LENGTH, ROWS = 2048, 64
END_ID = 2
#: Characters of texts that are encoded at once.
CHARS = 1_600_000
#: The character that stands for each byte in a byte-level vocabulary: printing ones for themselves, the others from U+0100 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_NAMES = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))


class LibraryEncoder:
    """The ids that the tokenizers library gives each text, with its own settings and without special tokens around it.

    Where the file's tokenizer is byte-level without a normaliser, truncation or padding, the library's model encodes each distinct piece of the texts
    once; a text that holds the string of an added token, as ``<|endoftext|>``, and any text of another tokenizer is encoded by it whole.
    """

    def __init__(self, tokenizer_file: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.piecewise = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Encoder(self._words, 128_000_000, CHARS, PackedPieces)
        self.most = max(self.library.get_vocab(with_added_tokens=True).values())

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of pieces by the library's model: each is one match of the splitter already, so only its bytes are left to name."""
        tokenize = self.library.model.tokenize
        return [[t.id for t in tokenize(charmap_decode(w.encode(), "strict", BYTE_NAMES)[0])] for w in words]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not self.piecewise or any(a in t for a in self.added) for t in texts]
        ids = iter(self.pieces([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if w else next(ids) for t, w in zip(texts, whole, strict=True)]


def held(tokenizer_file: str) -> LibraryEncoder:
    """This worker's encoder."""
    return hold(("tokens", tokenizer_file), lambda: LibraryEncoder(tokenizer_file))


class SequenceWriter:
    """Packs documents into one pair of files, a batch at a time."""

    def __init__(self, base: str, id_type: pa.DataType, length: int = LENGTH, rows: int = ROWS, token_type: pa.DataType = pa.uint16()):
        self.fs, self.base = open_fs(base)
        self.length, self.rows, self.dtype = length, rows, token_type.to_pandas_dtype()
        self.schema = pa.schema([("tokens", pa.list_(token_type, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.temp = f"{self.base}.{uuid.uuid4().hex}.tmp"
        self.sink = self.fs.open_output_stream(f"{self.temp}.seq")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(f"{self.temp}.docs")
        self.docs = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.pending: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0

    def add(self, ids: pa.Array, tokens: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = self.total + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([ids, pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.pending.append(np.concatenate(tokens).astype(self.dtype))
        self.total += int(sizes.sum())
        self.held += int(sizes.sum())
        self.n_docs += len(tokens)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        tokens = np.concatenate(self.pending or [np.zeros(0, self.dtype)])
        size = self.length * self.rows
        full = len(tokens) // size * size
        for k in range(0, full, size):
            self._batch(tokens[k:k + size], size)
        tokens = tokens[full:]
        if last and len(tokens):
            self._batch(np.pad(tokens, (0, -len(tokens) % self.length)), len(tokens))
            tokens = tokens[:0]
        self.pending, self.held = [tokens], len(tokens)

    def _batch(self, tokens: np.ndarray, used: int) -> None:
        mask = np.packbits(np.arange(len(tokens)) < used, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(tokens), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.sink, self.docs, self.docs_sink):
            x.close()
        for kind in ("seq", "docs"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.base}.{kind}.arrow")


class SequenceFile:
    """Random access to a file's sequences; a local file is memory-mapped and gives views."""

    def __init__(self, base: str):
        fs, path = open_fs(base)
        local = fs.type_name == "local"
        read = lambda p: pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p))
        self.file, self.docs = read(f"{path}.seq.arrow"), read(f"{path}.docs.arrow")
        self.length = self.file.schema.field("tokens").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask bytes of row i."""
        batch, k = self.file.get_batch(i // self.rows), i % self.rows
        return tuple(batch.column(c).flatten().to_numpy()[k * n:(k + 1) * n] for c, n in ((0, self.length), (1, self.length // 8)))

    def tokens(self) -> Iterator[np.ndarray]:
        """The tokens, without padding, a batch at a time."""
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            tokens, mask = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            yield tokens if mask[-1] == 255 else tokens[:int(np.unpackbits(mask).sum())]


def write(docs: DataFrame, tokenizer_file: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
          length: int = LENGTH, rows: int = ROWS) -> list[tuple[str, int, int]]:
    """Write the data set; returns (file, tokens, documents) of each file, in order."""
    spark = docs.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "tokens")
    fs, where = open_fs(path)
    fs.create_dir(where)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range's sample holds its keys, so the tie between equal ids is a hash, not the text.
    ordered = docs.select(id_col, text_col, F.xxhash64(text_col).alias("tie")).repartitionByRange(n, id_col, "tie").sortWithinPartitions(id_col, "tie").select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, writer = f"{path}/part-{TaskContext.get().partitionId():06d}", None
        encode = held(tokenizer_file)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            writer = writer or SequenceWriter(base, batch.column(0).type, length, rows, pa.uint16() if max(encode.most, end_id) < 1 << 16 else pa.uint32())
            for a, b in groups(texts, CHARS):
                writer.add(batch.column(0).slice(a, b - a), [np.concatenate([x, end]) for x in encode(texts[a:b])])
        if writer:
            writer.close()
            yield pa.record_batch({"file": pa.array([base]), "tokens": pa.array([writer.total]), "docs": pa.array([writer.n_docs])})

    return sorted(tuple(r) for r in ordered.mapInArrow(tidy(run), "file string, tokens bigint, docs bigint").collect())  # one row per file


def spans(spark: SparkSession, files: list[tuple[str, int, int]], id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, read from the files."""
    ship(spark)
    starts, at = [], 0
    for name, tokens, _ in files:
        starts.append((name, at))
        at += tokens
    files_of = listed(spark, starts, "file string, first bigint").repartition(max(1, len(starts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = SequenceFile(name)
                chunks, at = file.tokens(), 0
                chunk = np.zeros(0, np.uint32)
                for b in range(file.docs.num_record_batches):
                    docs = file.docs.get_batch(b)
                    crcs = []
                    for start, size in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc, pos, stop = 0, start, start + size
                        while pos < stop:
                            if pos >= at + len(chunk):
                                at += len(chunk)
                                chunk = next(chunks)
                                continue
                            some = chunk[pos - at:stop - at]
                            crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                            pos += len(some)
                        crcs.append(crc)
                    yield pa.record_batch({"doc_id": docs.column(0), "start": pa.array(docs.column(1).to_numpy() + first), "n_tokens": docs.column(2), "ids_crc32": pa.array(crcs, pa.int64())})

    return files_of.mapInArrow(tidy(run), f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
