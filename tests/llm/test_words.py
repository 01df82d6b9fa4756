import numpy as np
import pyarrow as pa

from choicespark.llm.words import word_blocks, words
from helpers import words as plain
from llm_fixtures import rng  # noqa: F401


def test_words_have_equal_hashes_where_equal_and_other_ones_elsewhere(rng):
    text = " ".join("".join(rng.choice("abABé") for _ in range(rng.randint(1, 4))) for _ in range(3000)) + "\t\nx\x0b\x0cy"
    start, h = words(text.encode().lower())
    ws = plain(text)
    assert len(h) == len(ws)
    assert len(set(zip(ws, h.tolist()))) == len(set(ws)) == len(set(h.tolist()))


def test_hash_does_not_depend_on_place_or_block():
    texts = ["alpha beta", None, "", "  Beta\n", "gamma alpha beta alpha", "alpha" * 900_000]
    whole = {i: h[at[i - a]:at[i - a + 1]].tolist() for a, b, at, h in word_blocks(pa.array(texts)) for i in range(a, b)}
    small = {i: h[at[i - a]:at[i - a + 1]].tolist() for a, b, at, h in word_blocks(pa.array(texts), 3) for i in range(a, b)}
    assert whole == small and [len(whole[i]) for i in range(6)] == [2, 0, 0, 1, 4, 1]
    assert whole[0][1] == whole[3][0] == whole[4][2]


def test_long_buffers_are_cut_at_white_space_only():
    text = ("word%d " * 5).encode() % tuple(range(5)) + b"z" * (5 << 20) + b" end"
    _, h = words(text)
    assert len(h) == 7 and h[-1] == words(b"end")[1][0]
    assert h[5] == words(b"z" * (5 << 20))[1][0]
    assert h.dtype == np.uint64
