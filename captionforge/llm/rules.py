"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean expression that rejects a text. Its cost is the time to evaluate it on a sample,
its selectivity the share of the sample that it rejects; rules run in the order of rejection per cost, and a
text leaves at the first rule that rejects it. The order never changes which texts are kept, so timings
may vary between runs.

The sample (about ``SAMPLE`` rows, each drawn by itself) only orders the rules; every rule sees every whole
text that reaches it. Defined cases: a null text has no words and counts like an empty one; repeated rows
are judged each; an empty table keeps the rules' given order; added columns replace columns of the same name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.session import materialize

SAMPLE = 2000

WORDS = "__words"
SPACE = r"[\x20\x09-\x0D]+"


def body(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than space and the controls from tab to carriage return."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda would otherwise compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(words: Column) -> Column:
    """A 64-bit hash of each three consecutive words."""
    places = lambda w: F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(places(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def n_repeat_words(windows: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Only texts with an equal pair of windows are looked at further: sorted (window, place) pairs show equal neighbours,
    and a word counts once however many such windows it lies in: a repeated window adds the words from
    the end of the repeated window before it, three at most.
    """
    repeated = lambda placed: F.filter(
        F.transform(placed, lambda p, k: F.when(
            (F.get(placed, k - 1)["h"] == p["h"]) | (F.get(placed, k + 1)["h"] == p["h"]), p["i"])),
        lambda i: i.isNotNull())
    covered = lambda starts: F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n"), i.alias("last")), lambda s: s["n"])
    placed = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = lambda w: covered(F.sort_array(let(placed(w), repeated)))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), count(w)).otherwise(F.lit(0).cast("long")))


@dataclass(frozen=True)
class Rule:
    """``rejects`` may use the text column and ``WORDS``, the text's words."""

    name: str
    rejects: Column


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of each text, split once for all rules."""
    return docs.withColumn(WORDS, words(body(text_col)))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules of common web corpora: word length, symbols, upper case, letters, repeated lines, marks, long runs."""
    text, count = body(text_col), F.size(WORDS)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("mean_word_length", (word_chars(F.col(WORDS)) < 2 * count) | (word_chars(F.col(WORDS)) > 20 * count)),
        Rule("symbols", n_symbols(text) * 2 > count),
        Rule("upper_case", upper * 10 > letters * 6),
        Rule("few_letters", letters * 2 < F.length(text)),
        Rule("duplicate_lines", n_dup_lines(text) * 10 > lines * 3),
        Rule("exclamation", F.length(F.regexp_replace(text, "[^!]+", "")) * 5 > count),
        Rule("ellipsis_lines", F.size(F.filter(F.split(text, "\n"), lambda line: line.endswith("..."))) * 10 > lines * 3),
        Rule("long_word", F.exists(WORDS, lambda w: F.length(w) > 1000)),
    ]


def measure(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on the sample."""
    share = min(1.0, 1.2 * sample / max(1, docs.count()))
    some = materialize(with_words(docs.select(text_col).sample(share, 7).limit(sample), text_col), "rule-sample")
    some.agg(F.max(F.size(WORDS))).collect()  # so that the first rule does not pay for opening the table
    out = []
    for rule in rules:
        began = time.perf_counter()
        row = some.agg(F.count(F.lit(1)).alias("n"), F.count_if(rule.rejects).alias("bad")).first()
        out.append((rule, time.perf_counter() - began, row["bad"] / max(1, row["n"])))
    return out


def ordered(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, ties by name."""
    return [m[0] for m in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[0].name))]


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules are not evaluated."""
    verdict = None
    for rule in rules:
        hit = F.coalesce(rule.rejects, F.lit(False))
        verdict = F.when(hit, F.lit(rule.name)) if verdict is None else verdict.when(hit, F.lit(rule.name))
    return verdict if verdict is not None else F.lit(None).cast("string")


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order in which ``docs`` should be judged."""
    return ordered(measure(docs, default_rules(text_col) if rules is None else rules, sample, text_col))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` that no rule rejects."""
    order = cascade(docs, rules, text_col, sample)
    return with_words(docs, text_col).where(first_rejection(order).isNull()).drop(WORDS)
