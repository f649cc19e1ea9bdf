"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A document's measures (lengths, symbols, stop words, lines, repeats) are columns of built-in functions; each row of
``RULES`` compares one measure with its bounds, and a document is kept if no base rule and no row fails.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are read whole; repeated
rows are judged one by one; a value on a threshold passes; an empty table gives an empty result; extra columns are kept, whatever their
names (measures replace namesakes).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import let, temp_name, words

SYMBOLS = "#*$%&|<>"
SHOUT = "!"
#: Very common words of the languages served.
STOP_WORDS = (
    "the of and to in is that with for it as was on by be this are from at or an "
    "de la le et les des un une du que qui pour par sur est au en dans "
    "el los las y se del con una por para su al lo como "
    "der die und den von das mit sich auf ist ein eine zu im nicht für dem"
).split()


class Rule(NamedTuple):
    """A measure must lie within [least, most]; None: no bound."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: The threshold table.
RULES = (
    Rule("mean word length", "mean_word_chars", 1.5, 15.0),
    Rule("symbols to words", "symbol_ratio", None, 0.10),
    Rule("exclamations to words", "shout_ratio", None, 0.30),
    Rule("upper-case letters to letters", "upper_ratio", None, 0.40),
    Rule("words that are stop words", "stop_ratio", 0.06, None),
    Rule("lines that repeat", "dup_line_ratio", None, 0.30),
)

#: Positions fit into this many bits of a sort key; longer texts sort structures instead.
POSITION_BITS = 20


def _repeated(w: Column) -> Column:
    """Words that stand in a 3-word window which occurs twice or more in the array ``w``.

    Windows are found by sorting one long each, the window's hash over its position; neighbours with the same hash are
    then compared as words, so a clash of hashes changes nothing.
    """
    gram = lambda w, p: F.concat_ws(" ", w[p], w[p + 1], w[p + 2])
    mask = (1 << POSITION_BITS) - 1
    positions = lambda w: F.sequence(F.lit(0), F.size(w) - 3)

    def near(sorted_keys: Column, same) -> Column:
        """Elements that are the ``same`` as a neighbour."""
        return F.filter(
            sorted_keys,
            lambda x, i: ((i > 0) & same(x, F.get(sorted_keys, i - 1))) | ((i < F.size(sorted_keys) - 1) & same(x, F.get(sorted_keys, i + 1))),
        )

    def hashed(w: Column) -> Column:
        keys = F.sort_array(F.transform(positions(w), lambda p: F.xxhash64(w[p], w[p + 1], w[p + 2]).bitwiseAND(~mask).bitwiseOR(p.cast("long"))))
        alike = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.lit(~mask)) == 0
        return let(keys, lambda k: F.transform(near(k, alike), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")))

    def exact(w: Column, at: Column) -> Column:
        pairs = F.sort_array(F.transform(at, lambda p: F.struct(gram(w, p).alias("g"), p.alias("p"))))
        return let(pairs, lambda k: F.transform(near(k, lambda a, b: a["g"] == b["g"]), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def count(w: Column) -> Column:
        maybe = F.when(F.size(w) <= mask, hashed(w)).otherwise(positions(w))
        return let(maybe, lambda at: F.when(F.size(at) == 0, 0).otherwise(covered(exact(w, at))))

    return let(w, lambda w: F.when(F.size(w) < 4, 0).otherwise(count(w))).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the ratios that RULES names."""
    body = F.coalesce(F.col(text), F.lit(""))
    count_of = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("double")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    found = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    stop_count = count_of(r"(?iu)(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(STOP_WORDS)) + r")(?![^\x20\x09-\x0D,.;:!?])")
    measures, by_line = temp_name(df, "measures_"), temp_name(df, "lines_")
    at = lambda name: F.col(measures)[name]
    df = df.withColumn(measures, found).withColumn(by_line, line_counts)
    df = df.withColumns(
        {
            "n_words": at("n_words"),
            "word_chars": F.char_length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.col(by_line)["dup"],
            "n_repeat_words": at("n_repeat_words"),
            "n_lines": F.col(by_line)["n"],
            "n_stop_words": stop_count,
            "n_shouts": count_of(SHOUT),
            "n_upper": count_of(r"\p{Lu}"),
            "n_letters": count_of(r"\p{L}"),
        }
    ).drop(measures, by_line)
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "shout_ratio": per("n_shouts", "n_words"),
            "upper_ratio": per("n_upper", "n_letters"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
        }
    )


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, kept and failed_rules (the names of the rows of ``rules`` that fail)."""
    df = measure(df, text)

    def fails(rule: Rule) -> Column:
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (F.col(rule.measure) < F.lit(rule.least))
        if rule.most is not None:
            bad = bad | (F.col(rule.measure) > F.lit(rule.most))
        return bad

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))
    df = df.withColumns({"base_failed": base, "failed_rules": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
