"""Quality rules: a table of thresholds compiled into one projection of native functions.

Each rule bounds a ratio of counts taken from the whole text: length, symbols, stop-words, lines and repeats.
Nothing is shuffled. Windows of five words are compared within the row: they are hashed, and only rows in which
some hash comes twice sort their windows to find the words that repeats cover.

A NULL text counts as empty; an empty text has zeros everywhere, fails the base rule and is not kept. Ratios over
nothing are 0. Repeated rows each give their own row; other columns of the input are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import SPACES, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Very frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "sur", "un", "une",
    "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)


class Rule(NamedTuple):
    """``over`` in hundredths of ``under`` must lie from ``least`` to ``most``; None: no bound."""

    name: str
    over: str
    under: str
    least: int | None
    most: int | None


BASE = (Rule("few_words", "n_words", "one", 1000, None), Rule("repeats", "n_repeat_words", "n_words", None, 20))
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1400),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("line_length", "word_chars", "n_lines", 1000, None),
    Rule("upper_case", "n_upper", "word_chars", None, 40),
    Rule("exclamation", "n_exclamation", "n_words", None, 20),
    Rule("same_word_runs", "n_same_as_before", "n_words", None, 15),
)


def _characters(text: Column, kept: str) -> Column:
    return F.length(text) - F.length(F.translate(text, kept, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """The counts behind the rules, one row per row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    base = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    hashed = base.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    windows = F.when(
        F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.select("*", windows.alias("g"))
    placed = F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    hashed = hashed.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(placed)).alias("s"))

    def again(e: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get("s", j)["x"] == e["x"], F.lit(False))
        return same(k - 1) | same(k + 1)

    repeated = F.sort_array(F.transform(F.filter("s", again), lambda e: e["i"]))
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    stop = F.size(F.filter("w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))))
    same = F.size(F.filter("h", lambda x, i: F.coalesce(F.get("h", i - 1) == x, F.lit(False))))
    return hashed.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _characters(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        stop.cast("long").alias("n_stop_words"),
        same.cast("long").alias("n_same_as_before"),
        _characters(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _characters(F.col("text"), "!").cast("long").alias("n_exclamation"),
        F.lit(1).cast("long").alias("one"),
    )


def broken(rule: Rule) -> Column:
    """Whether the counts break the rule; compared in whole numbers."""
    over, under = F.col(rule.over) * 100, F.col(rule.under)
    low = over < under * rule.least if rule.least is not None else F.lit(False)
    high = over > under * rule.most if rule.most is not None else F.lit(False)
    return low | high


def quality_rules(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Counts, the names of broken rules, and whether the text is kept."""
    counted = statistics(docs)
    names = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in (*base, *rules)]))
    fails = F.col("n_words") < 0
    for r in base:
        fails = fails | broken(r)
    return (
        counted.withColumn("broken", names)
        .withColumn("base_failed", fails)
        .withColumn("kept", F.size("broken") == 0)
        .drop("one")
    )
