"""What the findings of round 2 asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomsearch.llm import pretoken, token_files
from loomsearch.llm.queries import TOKENIZER_FILE

from .test_operators import random_texts

# 7


@pytest.fixture(scope="module")
def encoder():
    return token_files.LibraryEncoder(TOKENIZER_FILE)


def test_known_pieces_are_kept():
    """Within its bound an encoder keeps 800 000 pieces, so the second reading of the texts encodes none."""
    encoder = token_files.LibraryEncoder(TOKENIZER_FILE)
    given = []
    encoder.pieces.encode_words = lambda words: given.append(len(words)) or [[len(w)] * 3 for w in words]
    letter = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(letter[[k // 26**3 % 26, k // 26**2 % 26, k // 26 % 26, k % 26, k // 26**4]]) for k in range(800_000)]
    texts = [" " + " ".join(words[k:k + 50_000]) for k in range(0, len(words), 50_000)]
    for _ in range(2):
        for t in texts:
            assert encoder([t])[0].tolist() == [6] * 150_000
    assert sum(given) == len(words)


def words_of(rng: random.Random) -> list[str]:
    """Pieces of all lengths around the packed ones' bound, some the beginning of others or differing by zero bytes alone."""
    words = {"a" * n for n in range(1, 40)} | {"\0" * n for n in range(1, 40)} | {"a" * n + "\0" * m for n in range(1, 18) for m in range(3)}
    words |= {"é" * n for n in range(1, 12)} | {"日" * n for n in range(1, 12)} | {"😀" * n for n in range(1, 8)}
    words |= {"".join(rng.choices("ab\0é日\x7f\U0010ffff", k=rng.randint(1, 18))) for _ in range(1500)}
    return sorted(words)


@pytest.mark.parametrize("crowded", [False, True])
def test_packed_pieces(monkeypatch, crowded):
    """Each piece gets its own ids, also where all searches begin in one slot."""
    if crowded:
        monkeypatch.setattr(pretoken.PackedPieces, "_first", lambda self, low, high: np.zeros(len(low), np.int64))
    rng = random.Random(7)
    words, known, given = words_of(rng), pretoken.PackedPieces(), []
    number = {w: [k] * (k % 4) for k, w in enumerate(words)}

    def encode(some):
        given.extend(some)
        return [number[w] for w in some]

    for _ in range(12):
        some = rng.choices(words, k=900)
        begin, count = known.places(pa.array(some), encode)
        assert [known.flat[b:b + c].tolist() for b, c in zip(begin, count, strict=True)] == [number[w] for w in some]
    assert len(given) == len(set(given))
    assert [len(x) for x in known.places(pa.array([], pa.string()), encode)] == [0, 0]


def test_byte_names():
    from tokenizers.pre_tokenizers import ByteLevel

    assert sorted(token_files.BYTE_NAMES) == sorted(ByteLevel.alphabet())
    split = ByteLevel(add_prefix_space=False, use_regex=False)
    for text in [chr(c) for c in range(1, 0x900)] + ["日", "￿", "\U0010ffff", "😀"]:
        assert split.pre_tokenize_str(text)[0][0] == "".join(token_files.BYTE_NAMES[b] for b in text.encode())


def test_pieces_like_library(encoder):
    """By the library's model and from the table, first and second time, as by the library on whole texts; also when the table is begun anew for each group."""
    rng = random.Random(3)
    texts = [*random_texts(300, 5), *words_of(rng)[:400], "".join(words_of(rng)), " ".join(words_of(rng)), "x<|endoftext|> y", "'s've 'll''re", "a b\x85c  d"]
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (128_000_000, 0):
        encoder.pieces.limit = limit
        for _ in range(2):
            assert [x.tolist() for x in encoder(texts)] == want


def test_settings_of_the_file(tmp_path):
    """A file that truncates does so to whole texts."""
    import json

    with open(TOKENIZER_FILE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "short.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    encoder = token_files.LibraryEncoder(str(path))
    texts = ["one two three four five six", "", "x"]
    assert [x.tolist() for x in encoder(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts] and len(encoder(texts)[0]) == 3
