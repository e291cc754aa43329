"""Caption rules against plain Python worked out from their definition."""

import random

import pytest
from pyspark.sql import functions as F

from captionforge.functions import captions as C


def strip_all(text):
    for opening, replacement in C.OPENINGS:
        text = text.replace(opening, replacement)
    return text


def strip_fold(text):
    for opening, replacement in C.OPENINGS:
        opening, replacement = opening[0].upper() + opening[1:], replacement[:1].upper() + replacement[1:]
        if opening in text:
            text = text.replace(opening, replacement, 1).capitalize()
    return text.strip()


def reject(text):
    repeats = sum(text.count(p) for p in C.REJECT_PHRASES)
    return None if repeats > 5 or len(set(text.split())) < 3 else text


def random_captions(n, seed=0):
    rng = random.Random(seed)
    pieces = [o for o, _ in C.OPENINGS] + [o[0].upper() + o[1:] for o, _ in C.OPENINGS] + C.REJECT_PHRASES
    pieces += ["a cat ", "Dog", " ", "\t", "the ", "image ", "in ", "this ", "é", "in this in the image, ", ". ", "x x x "]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def apply(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", fn(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.fixture(scope="module")
def texts():
    fixed = ["", " ", "the image is ", "In the image, In the image, a cat", "A b c", "a a a a", "ab abc ab abc", "a b", "a b a b ",
             "a ab a", "ab a abc", "the the the the end", "a b c", "  lead", "\x1cx y z\x1f", "x" * 50]
    return fixed + random_captions(3000)


def test_strip_openings_all(spark, texts):
    assert apply(spark, texts, C.strip_openings_all) == [strip_all(t) for t in texts]


def test_strip_openings_fold(spark, texts):
    assert apply(spark, texts, C.strip_openings_fold) == [strip_fold(t) for t in texts]


def test_caption_reject(spark, texts):
    assert apply(spark, texts, C.caption_reject) == [reject(t) for t in texts]


def test_reject_of_long_repetition(spark):
    long = ["no " * 200_000, "no yes " * 100_000, "no yes " * 100_000 + "maybe"]
    assert apply(spark, long, C.caption_reject) == [None, None, long[2]]


def test_trim_and_capitalize(spark, texts):
    assert apply(spark, texts, C.trim_text) == [t.strip() for t in texts]
    assert apply(spark, texts, C.capitalize) == [t.capitalize() for t in texts]


def test_null_captions_stay_null(spark):
    for fn in (C.strip_openings_all, C.strip_openings_fold, C.caption_reject, C.trim_text, C.capitalize):
        assert apply(spark, [None], fn) == [None]
    assert apply(spark, [None, ""], lambda t: C.clean_text(t, 1, t)) == ["", ""]


def test_clean_text_draws(spark):
    texts = [f"A dog and An owl {i}." for i in range(400)]
    seen = set(apply(spark, texts, lambda t: C.clean_text(t, 3, t)))
    kinds = {(s.startswith("dog"), s.endswith(".")) for s in seen}
    assert len(kinds) == 4
    assert all("An owl" in s or "A " not in s for s in seen)


def test_synonyms_and_class_caption(spark):
    got = apply(spark, ['tench, "Tinca tinca" , ,', " , "], C.synonyms)
    assert got == [["tench", "Tinca tinca"], []]
    captions = apply(spark, ["a,b"] * 3 + [","], lambda t: C.class_caption(t, 1, t))
    assert set(captions[:3]) <= {"a photo of a a", "a photo of a b"} and captions[3] is None


def test_prompts(spark):
    prompt = apply(spark, ["a hint"], C.long_caption_prompt)[0]
    assert "\\`\\`\\`\n    a hint\n    \\`\\`\\`" in prompt and prompt.startswith("\n    Please make")
    messages = apply(spark, ["cap"], C.short_caption_messages)[0]
    assert [m["role"] for m in messages] == ["system", "user"] and "cap" in messages[1]["content"]


def test_paths(spark):
    paths = ["/a/b/n01_5.JPEG", "x.tar.gz", "noext", "a/.hidden"]
    assert apply(spark, paths, C.file_stem)[:3] == ["n01_5", "x.tar", "noext"]
    assert apply(spark, paths, C.file_extension)[:3] == ["jpeg", "gz", ""]
    assert apply(spark, ["n01_5"], C.stem_prefix) == ["n01"]
