"""Caption text functions, all built from JVM-side expressions."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform

# Stock openings that captioning models repeat, and what replaces each one.
# The order is part of the result.
OPENINGS = [
    ("the image showcases ", ""),
    ("the image portrays ", ""),
    ("the image appears to be ", ""),
    ("the image is ", ""),
    ("the image depicts ", ""),
    ("the image features ", ""),
    ("the image captures ", ""),
    ("the image shows ", ""),
    ("the image displays ", ""),
    ("the image presents ", ""),
    ("this image showcases ", ""),
    ("this image portrays ", ""),
    ("this image appears to be ", ""),
    ("this image is ", ""),
    ("this image depicts ", ""),
    ("this image features ", ""),
    ("this image captures ", ""),
    ("this image shows ", ""),
    ("this image displays ", ""),
    ("this image presents ", ""),
    ("in this picture, ", ""),
    ("in this artwork, ", "artwork of "),
    ("in this illustration, ", "illustration of "),
    ("in this depiction, ", ""),
    ("in this piece, ", ""),
    ("in this image, ", ""),
    ("in this art piece, ", "art of "),
    ("in this scene, ", ""),
    ("in the picture, ", ""),
    ("in the artwork, ", "artwork of "),
    ("in the illustration, ", "illustration of "),
    ("in the depiction, ", ""),
    ("in the piece, ", ""),
    ("in the image, ", ""),
    ("in the art piece, ", "art of "),
    ("in the scene, ", ""),
]

# Phrases whose repetition marks a failed caption.
REJECT_PHRASES = [" no text", " other objects", " additional objects", " no objects ", "alt-text"]
MAX_REJECT_PHRASES = 5
MIN_DISTINCT_TOKENS = 3

# The two model prompts, with {} where the hint or caption goes.
LONG_CAPTION_PROMPT = (
    "\n    Please make a detailed but succinct caption of this image. If you see text or objects, "
    "be sure to describe them in detail along with any other aspects of the foreground and "
    "background. If there is any important text in the image, include it in the caption. As a "
    "hint, here is the alt-text attribute of the image, which may or may not have to do with the "
    "image:\n\n    Hint:\n    \\`\\`\\`\n    {}\n    \\`\\`\\`\n    "
)
SHORT_CAPTION_PROMPT = (
    "\n    Please take the following image caption and attempt to distill it into a single "
    "sentence. Remove any redundant lines or descriptions and make it a maximum of 40 words in "
    "length.\n\n    \\`\\`\\`\n    {}\n    \\`\\`\\`\n\n    Please only write the caption and no "
    "other text.\n    "
)
SYSTEM_MESSAGE = "You are a helpful assistant"

# Every character Python's str.strip and str.split treat as whitespace. SQL trim knows only the
# space, and regex \s differs between engines, so the set is spelled out.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680,
                               *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _upper_first(text: str) -> str:
    return text[:1].upper() + text[1:]


def trim_text(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))


def _guarded(text: Column, rewrite, upper: bool = False) -> Column:
    """Apply ``rewrite(text, openings)`` to each run of openings that share their first two words.

    A text without those words cannot contain any opening of the run, so most texts are
    scanned once per run instead of once per opening.
    """
    cased = [(_upper_first(o), _upper_first(r)) if upper else (o, r) for o, r in OPENINGS]

    def guard(start: str, openings: list):
        return lambda t: F.when(F.contains(t, F.lit(start)), rewrite(t, openings)).otherwise(t)

    for start, run in groupby(cased, key=lambda pair: " ".join(pair[0].split()[:2]) + " "):
        text = let(text, guard(start, list(run)))
    return text


def strip_openings_all(text: Column) -> Column:
    """Replace every occurrence of each lower-case opening, in list order."""

    def rewrite(t: Column, openings) -> Column:
        for opening, replacement in openings:
            t = F.replace(t, F.lit(opening), F.lit(replacement))
        return t

    return _guarded(text, rewrite)


def strip_openings_fold(text: Column) -> Column:
    """For each capitalised opening the text contains: replace the first occurrence, then
    capitalise the whole text (so later openings can match only at its start).

    A fold over the openings, because a chain of conditionals would repeat its input at
    every level and the plan would grow exponentially.
    """

    def step(acc: Column, item: Column) -> Column:
        opening, replacement = item["o"], item["r"]
        replaced = F.overlay(acc, replacement, F.position(opening, acc), F.length(opening))
        return F.when(F.contains(acc, opening), capitalize(replaced)).otherwise(acc)

    def rewrite(t: Column, openings) -> Column:
        pairs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(r).alias("r")) for o, r in openings])
        return F.aggregate(pairs, t, step)

    return trim_text(_guarded(text, rewrite, upper=True))


def caption_repeats(text: Column) -> Column:
    """Non-overlapping occurrences of the reject phrases, summed."""
    total = F.lit(0).cast("long")
    for phrase in REJECT_PHRASES:
        # the phrases are ASCII, so bytes count as characters and no text is decoded
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(phrase), F.lit("")))
        total = total + F.floor(removed / len(phrase))
    return total


def _distinct_words_pattern(count: int) -> str:
    """A pattern matching texts with at least ``count`` distinct words.

    Each step skips repeats of the words captured so far and captures the next new one, so an
    ordinary text is decided by its first few words. Possessive quantifiers keep it linear.
    """
    space, word = f"[{WHITESPACE}]", f"[^{WHITESPACE}]"
    pattern = rf"\A{space}*+({word}++)"
    for known in range(1, count):
        seen = "|".join(rf"\{i}" for i in range(1, known + 1))
        pattern += rf"{space}++(?:(?:{seen}){space}++)*+(?!(?:{seen})\z)({word}++)"
    return pattern


def caption_reject(text: Column) -> Column:
    """Null for captions that repeat a reject phrase too often or have under three distinct words."""

    def judge(t: Column) -> Column:
        enough_words = F.rlike(t, F.lit(_distinct_words_pattern(MIN_DISTINCT_TOKENS)))
        return F.when(enough_words & (caption_repeats(t) <= MAX_REJECT_PHRASES), t)

    return let(text, judge)


def _fill(template: str, text: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), text, F.lit(after))


def long_caption_prompt(alt_text: Column) -> Column:
    return _fill(LONG_CAPTION_PROMPT, alt_text)


def short_caption_prompt(caption: Column) -> Column:
    return _fill(SHORT_CAPTION_PROMPT, caption)


def short_caption_messages(caption: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
        F.struct(F.lit("user").alias("role"), short_caption_prompt(caption).alias("content")),
    )


def clean_text(text: Column, seed: int, *key) -> Column:
    """Training-time augmentation: maybe drop articles, strip openings, maybe drop the final mark."""
    no_articles = F.replace(F.replace(text, F.lit("A "), F.lit("")), F.lit("An "), F.lit(""))
    stripped = strip_openings_all(F.when(hash_uniform(seed, *key, "article") < 0.5, no_articles).otherwise(text))

    def drop_mark(t: Column) -> Column:
        cut = F.right(t, F.lit(1)).isin(".", ",", "!", "?") & (hash_uniform(seed, *key, "mark") < 0.5)
        return F.when(cut, trim_text(F.substr(t, F.lit(1), F.length(t) - 1))).otherwise(t)

    return F.coalesce(let(stripped, drop_mark), F.lit(""))


def synonyms(names: Column) -> Column:
    """Comma-separated names to a clean list: trimmed, without double quotes, blanks dropped."""
    parts = F.filter(F.split(names, ","), lambda x: trim_text(x) != "")
    return F.transform(parts, lambda x: F.replace(trim_text(x), F.lit('"'), F.lit("")))


def class_caption(names: Column, seed: int, *key) -> Column:
    """``a photo of a <random synonym>``; null when there is no synonym."""
    options = synonyms(names)
    pick = F.floor(hash_uniform(seed, *key) * F.size(options)).cast("int")
    return F.concat(F.lit("a photo of a "), F.get(options, pick))


def batch_caption(long: Column, short: Column, seed: int, batch_id: Column) -> Column:
    """Long or short caption, one coin flip per batch."""
    return trim_text(F.when(hash_uniform(seed, batch_id) < 0.5, long).otherwise(short))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem_prefix(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def bucket_string(height: Column, width: Column) -> Column:
    return F.concat_ws("x", height.cast("string"), width.cast("string"))


def bucket_sides(bucket: Column) -> tuple[Column, Column]:
    parts = F.split(bucket, "x")
    return F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")


def shard_file_name(split: str, index: Column, total: Column) -> Column:
    return F.format_string(f"{split}-%05d-of-%05d", index, total)
