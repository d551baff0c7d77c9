"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit boundaries, and put in another order.

A unit grammar is stated as pairs of neighbouring character classes between which one unit ends and the next begins. It is
translated to a zero-width regular expression of look-behinds and look-aheads, at which Spark's ``split`` parts a text
and loses no character. All of it is built-in expressions on one row: no shuffle, no Python.

Where a text is cut, and in which form it is put out, is drawn from the SHA-256 of the seed and the document's id, so
reruns and other partitions give the same rows.

Defined results: a null or empty text has no units and comes out plain and empty; a text that contains one of the marks
comes out plain, as does a text of one unit or of thousands by the same draw; rows that share an id are cut by the same
draw, each in its own text; a null id draws as the word ``null``; an empty table gives no rows; other columns pass through,
one that bears the name of an output is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import free_name


@dataclass(frozen=True)
class Grammar:
    """Units as the classes of characters (before, after) that meet where one unit ends and the next one begins."""

    name: str
    meets: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The zero-width regular expression of all its boundaries."""
        return "|".join(f"(?<={before})(?={after})" for before, after in self.meets)


_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: White space belongs to the word after it; white space at the end is a unit.
WORDS = Grammar("words", ((_WORD, _SPACE),))
#: A line with its line break.
LINES = Grammar("lines", ((r"\n", r"[\s\S]"),))
#: Runs of letters, of digits, of white space, and single other characters, as in program code.
CODE = Grammar("code", tuple((f"[{a}]", f"[^{a}]") for a in (r"\p{L}_", r"\p{Nd}", r"\s")) + ((r"[^\p{L}_\p{Nd}\s]", r"[\s\S]"),))
CHARACTERS = Grammar("characters", ((r"[\s\S]", r"[\s\S]"),))


@dataclass(frozen=True)
class Settings:
    seed: str = "42"
    #: Of 100 documents, how many are rearranged, and how many of those with the suffix first.
    rate: int = 50
    suffix_first: int = 80
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"


def units(text: Column, grammar: Grammar = WORDS) -> Column:
    """Array of the units of a text; split() would give an empty text one unit."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def draws(doc_id: Column, seed: str, n: int = 4) -> list[Column]:
    """n numbers of 32 bits for each document."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def rearrange(docs: DataFrame, grammar: Grammar = WORDS, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null where plain) and output."""
    s, own = settings, free_name(docs.columns)
    marks = (s.prefix_mark, s.suffix_mark, s.middle_mark)
    t, u, a, b = (F.col(f"{own}{c}") for c in ("text", "units", "first", "second"))
    h = draws(F.col(doc_id), s.seed)
    out = docs.withColumn(f"{own}text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(f"{own}units", units(t, grammar))
    size = F.size(u).cast("long")
    cuts = [h[0] % (size + 1), h[1] % (size + 1)]
    out = out.withColumns({f"{own}first": F.least(*cuts).cast("int"), f"{own}second": F.greatest(*cuts).cast("int")})
    plain = (t == "") | (h[2] % 100 >= s.rate)
    for m in marks:
        plain = plain | F.contains(t, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < s.suffix_first, "spm").otherwise("psm")
    out = out.withColumns({"n": size, "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(u, start, length), ""))
    out = out.withColumns({"prefix": part(F.lit(1), a), "middle": part(a + 1, b - a), "suffix": part(b + 1, F.size(u))})
    p, x, m = (F.lit(v) for v in marks)
    output = (
        F.when(F.col("form") == "spm", F.concat(x, "suffix", p, "prefix", m, "middle"))
        .when(F.col("form") == "psm", F.concat(p, "prefix", x, "suffix", m, "middle"))
        .otherwise(t)
    )
    return out.withColumn("output", output).drop(*(f"{own}{c}" for c in ("text", "units", "first", "second")))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    s = settings
    piece = lambda k: F.get(F.split(output, "|".join(f"\\Q{m}\\E" for m in (s.prefix_mark, s.suffix_mark, s.middle_mark)), -1), F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def digest(rearranged: DataFrame) -> DataFrame:
    """Lengths of the parts, and SHA-256 of the outputs and of the texts rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rearranged.withColumns(
        {
            "prefix_chars": F.length("prefix").cast("long"),
            "middle_chars": F.length("middle").cast("long"),
            "output_sha256": sha(F.col("output")),
            "restored_sha256": sha(restored(F.col("output"), F.col("form"))),
        }
    )
