import random

import numpy as np
import pyarrow as pa
import pytest

from captionforge.llm import text as T

from .helpers import words


@pytest.mark.parametrize("group", [1, 5, 1 << 20])
def test_words_match_the_pattern(group):
    rng = random.Random(1)
    texts = ["", None, "Ab cd", "éÀ x", "x" * 200 + " y", "a", "b", " !", "z"]
    texts += ["".join(rng.choices("aZé 9.,\n中-", k=rng.randint(0, 30))) for _ in range(200)]
    got = []
    for w in T.word_groups(pa.array(texts, pa.string()), group):
        bounds = w.bounds()
        got += [[w.phrase(k, 1).decode() for k in range(bounds[r], bounds[r + 1])] for r in range(w.n_rows)]
    assert got == [words(t) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    word = "langeswort" * 9
    found = [w for w in T.word_groups(pa.array([f"{word} a", f"bb a {word}", f"{word}x"]))]
    hashes = np.concatenate([w.hash for w in found])
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4


def test_windows_stay_inside_a_text():
    (w,) = T.word_groups(pa.array(["a b c", "d", "a b c d"]))
    hashes, first = T.window_hashes(w, 3)
    assert first.tolist() == [0, 4, 5] and hashes[0] == hashes[1] != hashes[2]


def test_sliced_and_empty_columns():
    column = pa.array(["no", "a b", None, "c"])[1:]
    (w,) = T.word_groups(column)
    assert w.row.tolist() == [0, 0, 2]
    assert list(T.word_groups(pa.array([], pa.string()))) == []
