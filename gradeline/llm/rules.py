"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import word_array

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by this are or an from at which have has not but they you he she we "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des du et en un une que qui dans pour par sur pas au est il elle ce plus avec se sont ou "
    "el los las del y que en un una por con no se para como su al lo más pero sus este esta"
).split()

#: The columns that `measures` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")
SYMBOLS = "#*$%&|<>"
GRAM = 8


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= ratio <= high; a null ratio (no words, no lines) passes."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The verdict's threshold table; ratios are SQL over the columns of `measures`.
DEFAULT_RULES = (
    Rule("mean_word_chars", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.2),
    Rule("shouts_per_word", "n_shouts / n_words", None, 0.3),
    Rule("stop_words_per_word", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules use. A null text counts as empty. All columns stay; those named like a count are replaced.

    Words of 8-word windows that occur twice or more in a text are found by sorting the windows' 64-bit hashes, so a
    text of n words costs n log n steps, not n squared.
    """
    outer = [c for c in docs.columns if c not in COUNTS]
    df = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(outer)])
    given = F.col(f"c{outer.index(text_col)}")
    text = F.coalesce(given, F.lit(""))
    df = df.withColumns({"_text": text, "_words": word_array(given), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    starts = F.sequence(F.lit(1), F.size("_words") - GRAM + 1)
    df = df.withColumn("_grams", F.when(F.size("_words") >= GRAM, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, GRAM)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    )
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    repeated = F.transform("_sorted", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"]))
    df = df.withColumn("_at", F.sort_array(F.filter(repeated, lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get("_at", i + 1) - p, F.lit(GRAM)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length("_text") - _removed(F.col("_text"), " \t\n\x0b\x0c\r"),
        "n_symbols": _removed(F.col("_text"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_shouts": _removed(F.col("_text"), "!"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_lines": F.size("_lines"),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]"))),
    }
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(outer)], *[v.cast("long").alias(k) for k, v in counts.items()])


def verdict(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(kept, the names of the rules that fail) as expressions over the columns of `measures`."""
    failed = []
    for r in rules:
        ratio = F.expr("try_divide(cast(" + r.ratio.split(" / ")[0] + " as double), " + r.ratio.split(" / ")[1] + ")")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratio < r.low)
        if r.high is not None:
            bad = bad | (ratio > r.high)
        failed.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """Judge every document: the counts, `base_failed`, `failed_rules` and `kept`.

    base_failed: fewer than 20 words, or over 30 of 100 words in repeated 8-word windows. A null or blank text has no
    words and so fails. Long texts are read whole. Repeated rows are judged alike, each for itself; an empty table gives
    an empty result. Input columns of the same names are replaced.
    """
    df = measures(docs, text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept, names = verdict(rules)
    return df.withColumns({"base_failed": base, "failed_rules": names}).withColumn("kept", ~F.col("base_failed") & kept)
