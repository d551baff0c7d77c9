"""Text predicates and extractors as Column builders; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs, Latin letters and digits.
SOLID = r"一-鿿A-Za-z0-9"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def strings(words: Iterable[str]) -> Column:
    words = list(words)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def hits(text: Column, words: Iterable[str]) -> Column:
    """The words that text contains, in the order given; a word listed twice counts twice."""
    return F.filter(strings(words), lambda w: F.contains(text, w))


def has_hit(text: Column, words: Iterable[str]) -> Column:
    """Whether text contains one of the words."""
    words = list(words)
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def alias_hits(text: Column, aliases: Mapping[str, Iterable[str]]) -> Column:
    """Canonical words of which text contains the word itself or an alias."""
    found = [F.when(_any(F.contains(text, F.lit(w)) for w in (name, *others)), F.lit(name)) for name, others in aliases.items()]
    return F.array_compact(F.array(*found)) if found else strings(())


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def word_hits(text: Column, words: Iterable[str], aliases: Mapping[str, Iterable[str]]) -> Column:
    return sorted_set(F.concat(hits(text, words), alias_hits(text, aliases)))


def phones(text: Column, pattern: str) -> Column:
    """Phone numbers of eleven digits, sorted; longer and shorter runs are dropped."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)\D", ""))
    return sorted_set(F.filter(digits, lambda d: (F.length(d) == 11) & F.startswith(d, F.lit("1"))))


def matches(text: Column, pattern: str) -> Column:
    return sorted_set(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def has_contact_digits(text: Column) -> Column:
    return text.rlike(r"(?U)\d{6,}")


def has_phone_digits(text: Column) -> Column:
    return text.rlike(r"(?U)\d{7,}")


def has_partial_contact(text: Column) -> Column:
    return text.rlike(r"(?iU)微信|vx|wechat|QQ|手机|电话|1[3-9][0-9]{5,}")


def is_meaningful(text: Column) -> Column:
    return text.rlike(f"[{SOLID}]{{2,}}")


def is_punctuation_noise(text: Column) -> Column:
    return (strip(text) != "") & ~text.rlike(f"[{SOLID}]")


def solid_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SOLID}]", ""))


def normalized(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def is_similar(a: Column, b: Column) -> Column:
    """Of two normalized texts: equal, one within the other, or 65 % of the shorter one's places agree (three at least)."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    agree = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when(F.substr(short, i, F.lit(1)) == F.substr(long, i, F.lit(1)), 1).otherwise(0)
    )
    filled = (a != "") & (b != "")
    return filled & ((a == b) | F.contains(a, b) | F.contains(b, a) | ((n >= 3) & (agree / F.greatest(n, F.lit(1)) >= 0.65)))


#: is_similar_coded compares so many words of three characters, 21 bits each, as whole numbers; what is behind them as sets.
WORDS, LOW, HIGH = 8, sum((2**20 - 1) << k for k in (0, 21, 42)), sum(2**20 << k for k in (0, 21, 42))


def coded(text: Column) -> Column:
    """Struct (length, w0, w1, ..., rest) of what is_similar_coded asks of a text."""
    code = lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long") + 1
    at = lambda i: F.when(F.length(text) >= i, code(F.lit(i))).otherwise(F.lit(0).cast("long"))
    words = [F.shiftleft(at(k + 1), 42) + F.shiftleft(at(k + 2), 21) + at(k + 3) for k in range(0, 3 * WORDS, 3)]
    behind = F.transform(F.sequence(F.lit(3 * WORDS + 1), F.greatest(F.length(text), F.lit(3 * WORDS + 1))), lambda i: F.shiftleft(i.cast("long"), 21) + code(i))
    rest = F.when(F.length(text) > 3 * WORDS, behind).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.length(text).alias("length"), *[w.alias(f"w{k}") for k, w in enumerate(words)], rest.alias("rest"))


def is_similar_coded(a: Column, b: Column) -> Column:
    """is_similar of structs (t, and the fields of coded). There is no lambda, so it is compiled into a join of many pairs."""
    differ = lambda x: F.bit_count((x.bitwiseAND(F.lit(LOW)) + F.lit(LOW)).bitwiseOR(x).bitwiseAND(F.lit(HIGH)))
    apart = F.lit(0)
    for k in range(WORDS):
        apart = apart + differ(a[f"w{k}"].bitwiseXOR(b[f"w{k}"]))
    n, longest = F.least(a["length"], b["length"]), F.greatest(a["length"], b["length"])
    behind = F.when(n > 3 * WORDS, F.size(F.array_intersect(a["rest"], b["rest"]))).otherwise(0)
    agree = F.least(longest, F.lit(3 * WORDS)) - apart + behind
    within = F.when(a["length"] > b["length"], F.contains(a["t"], b["t"])).when(a["length"] < b["length"], F.contains(b["t"], a["t"])).otherwise(a["t"] == b["t"])
    return (n > 0) & (((n >= 3) & (agree / F.greatest(n, F.lit(1)) >= 0.65)) | within)


def encoded(content: Column) -> Column:
    """Base64 on one line; null of null. Sessions differ in whether base64() breaks lines."""
    return F.replace(F.base64(content.cast("binary")), F.lit("\r\n"), F.lit(""))
