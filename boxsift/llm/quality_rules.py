"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every measure is a built-in expression over the whole text, so a document is judged where it is read: no shuffle, no
Python. The one measure that looks across a text, repeated 3-word windows, sorts the hashes of the text's own windows and
compares neighbours word by word, n log n in the words of one document and never across documents.

Defined results: a null or empty text has no words and is rejected by the length rule; repeated rows are judged alike,
each on its own; an empty table gives an empty table; other columns pass through ``apply_rules`` untouched, and a
column whose name an output would take is replaced by that output; ``kept_rows`` returns the columns of its input as they
are, whatever their names. Of rules that share a name the last one counts.

Stop words are those of English, German, French and Spanish: a text in a language that shares none of them is rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import WORD_PATTERN, columns_of, free_name, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an have not which "
    "der die das und ist von den mit nicht ein eine dem des sich auf für als auch im zu "
    "le la les de et un une que des en dans pour est qui du au par sur avec pas "
    "el los las y del por con una no se su para al lo como más"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a document only while low <= measure <= high; a missing bound is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Bounds on the measures that ``measures`` defines.
RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.6),
    Rule("short_lines", "line_ratio", high=0.5),
    Rule("letterless_words", "letterless_ratio", high=0.4),
    Rule("capitals", "capital_ratio", high=0.6),
)
#: Of RULES, those that make up the base verdict.
BASE = ("too_few_words", "repeated_windows")


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of the named values, each worked out once a row: they are a lambda's variable, so no rewrite of the plan can put
    their expressions in place of their names (a pushed filter would, and work out a text's words anew for each of them)."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def counts(text: Column) -> Column:
    """Struct of the counts of a text."""

    def windows(t: Column) -> Column:
        """Starts of the 3-word windows with their hashes, in order of the hashes: equal windows are neighbours."""
        w = t["words"]
        hashed = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), hashed))

    def repeated(t: Column) -> Column:
        """Starts of windows found twice or more; neighbours of one hash are compared word by word."""

        def twice(a: Column, k: Column) -> Column:
            b = F.get(t["windows"], k + 1)
            same = a["h"] == b["h"]
            for j in range(3):
                same = same & (F.get(t["words"], a["i"] + j) == F.get(t["words"], b["i"] + j))
            return F.when(same, F.array(a["i"], b["i"]))

        return F.flatten(F.array_compact(F.transform(t["windows"], twice)))

    def covered(starts: Column) -> Column:
        return F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)))

    def counted(t: Column) -> Column:
        found = {
            "n_words": F.size(t["words"]),
            "word_chars": F.length(F.array_join(t["words"], "")),
            "n_symbols": F.length(t["text"]) - F.length(F.regexp_replace(t["text"], f"[{SYMBOLS}]+", "")),
            "n_dup_lines": F.size(t["lines"]) - F.size(F.array_distinct(t["lines"])),
            "n_repeat_words": F.size(bound({"starts": repeated(t)}, lambda r: covered(r["starts"]))),
            "n_lines": F.size(t["lines"]),
            "stops": F.size(F.filter(t["words"], lambda w: F.lower(w).isin(*STOP_WORDS))),
            "letterless": F.size(F.filter(t["words"], lambda w: ~w.rlike(r"\p{L}"))),
            "capitals": F.length(F.regexp_replace(t["text"], r"[^\p{Lu}]+", "")),
            "letters": F.length(F.regexp_replace(t["text"], r"[^\p{L}]+", "")),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()])

    def parted(t: Column) -> Column:
        lines = F.filter(F.split(t["text"], "\n"), lambda x: x.rlike(WORD_PATTERN))
        return bound({"text": t["text"], "words": t["words"], "lines": lines, "windows": windows(t)}, counted)

    return bound({"text": F.coalesce(text, F.lit("")), "words": words_of(text)}, parted)


#: Ratios of counts that the rules bound.
RATIOS = {
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("stops", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "line_ratio": ("n_lines", "n_words"),
    "letterless_ratio": ("letterless", "n_words"),
    "capital_ratio": ("capitals", "letters"),
}
#: Counts that are given out beside the ratios.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def compiled(rules: tuple[Rule, ...], measure: Callable[[str], Column]) -> dict[str, Column]:
    """Each rule as a boolean column over its measure, true where the rule fails."""
    out = {}
    for r in rules:
        m, fails = measure(r.measure), F.lit(False)
        fails = fails | (m < F.lit(r.low)) if r.low is not None else fails
        out[r.name] = fails | (m > F.lit(r.high)) if r.high is not None else fails
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of a text's counts and ratios, and of failed_rules, base_failed and kept."""

    def of_counts(t: Column) -> Column:
        c = t["counts"]
        per = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))
        return bound({**{k: c[k] for k in COUNTS}, **{k: per(*v) for k, v in RATIOS.items()}}, judged)

    def judged(m: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in compiled(rules, lambda k: m[k]).items()]))
        base = lambda f: F.exists(f["failed"], lambda x: x.isin(*BASE))
        told = [m[k].alias(k) for k in (*COUNTS, *RATIOS)]
        return bound({"failed": failed}, lambda f: F.struct(*told, f["failed"].alias("failed_rules"), base(f).alias("base_failed"), (F.size(f["failed"]) == 0).alias("kept")))

    return bound({"counts": counts(text)}, of_counts)


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """df with all measures, ``base_failed``, ``kept`` and ``failed_rules``, the names of the rules a row fails; prefix goes
    before their names. Rows may be filtered on any of them: a filter that Spark pushes below costs one more look at a text."""
    own = free_name([*df.columns, prefix or "-"])
    out = df.withColumn(own, verdict(F.col(text), rules))
    return out.withColumns({f"{prefix}{k}": F.col(own)[k] for k in (*COUNTS, *RATIOS, "failed_rules", "base_failed", "kept")}).drop(own)


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass all rules, as they are."""
    return df.where(verdict(F.col(text), rules)["kept"]).select(*columns_of(df))
