"""Mixing sources to target weights by Pareto order sampling.

``targets`` shares a word budget among the sources by weight; no target passes ``max_repeat`` times its source, and the
excess is shared again by weight until none does. ``expected_copies`` then spreads a source's target over its documents
in proportion to a measure of each, here the number of binary digits of its words, so that longer documents come a little
more often: expected copies are level * measure, ``max_repeat`` at most, with the level at which a source's expected words
are its target. ``mix`` allocates the whole copies floor(expected) for certain; what is left, between 0 and 1, is the
document's inclusion probability p. With a uniform number u it has the rank (u / (1 - u)) / (p / (1 - p)), random odds by
inclusion odds, and the lowest ranks of a source are taken until their words fill the rest of its target, so the sample
has a fixed size in words.

The cut in each source's ranking is found without sorting a source in one task: words are summed by (source, rank cell),
the crossing cell is found, split into finer cells and summed again; only the documents of the last crossing cell are
put in order. A source with a third of all rows is summed map-side and never gathered. Rows that share id, source and
text are told apart by a running number, counted within the parts of a written table and then over the parts, so that a
row repeated any number of times is drawn row by row and never gathered either. Tables with a row for each source, or for
each source and measure (64 at most), are the only ones whose windows hold all rows: sources are taken to be few.

Random numbers come from md5 of the seed, the id, the text and the running number: reruns, retried tasks and other
engines agree.

Defined results: a null or empty text has size 0 and takes 0 words; null is a source of its own, the last in order;
repeated rows, and rows without an id, are counted and drawn each on its own; an empty table gives no rows; the input's
other columns are not read and cannot clash, and ``mixed_rows`` returns the input's own columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxsift.llm.common import columns_of, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Bits of rank that each of the two passes over the sizes resolves.
CELL_BITS = 12


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n_docs, target): one row for each source of sizes (source, size).

    Sources in code point order, null last, take the weights in turn. The shared-out targets are min(cap, weight * level)
    for the one level at which they sum to the budget: with sources sorted by cap / weight, those before the level are
    capped. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn("cap", max_repeat * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # The first source that is not capped has the level for all after it.
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    share = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * final["level"])
    return per.select("source", "source_size", "n_docs", share.alias("target"))


def binary_digits(size: Column) -> Column:
    """The default measure: 0 for no words, else the number of binary digits of their count, 64 at most."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def expected_copies(sizes: DataFrame, shares: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, measure, source_size, target, expected, certain, chance, rest) of each source and measure in sizes (source,
    measure, size), with shares as ``targets`` gives them.

    expected = min(max_repeat, level * measure); measures are tried from the highest, which is the first to be capped.
    rest is what the certain copies of all of a source's documents leave of its target.
    """
    cells = sizes.groupBy("source", "measure").agg(F.sum("size").alias("words"))
    rows = cells.alias("a").join(shares.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select("a.*", "source_size", "target")
    own = Window.partitionBy("source")
    down = own.orderBy(F.desc("measure"))
    above = F.coalesce(F.sum(max_repeat * F.col("words")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("measure") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.try_divide(F.col("target") - above, below.cast("double")))
    rows = rows.withColumn("capped", F.col("measure") * F.col("level") >= max_repeat)
    final = F.min(F.when(~F.col("capped"), F.struct(-F.col("measure"), "level"))).over(own)["level"]
    share = F.when((F.col("measure") == 0) | (F.col("words") == 0), 0.0).when(F.col("capped"), float(max_repeat)).otherwise(F.col("measure") * final)
    rows = rows.withColumn("expected", share).withColumn("certain", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("certain"))
    return rows.withColumn("rest", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(own)).drop("words", "level", "capped")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the seed and the key only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


KEYS = ("doc_id", "source", "digest")


def _alike(a: str, b: str, *keys: str) -> Column:
    return _all(F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys)


def numbered(rows: DataFrame, repeated: DataFrame, some: bool) -> DataFrame:
    """rows with nth: 0, and 0, 1, 2, ... for the rows that share one of the keys in repeated."""
    if not some:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    once = rows.alias("a").join(repeated.alias("b"), _alike("a", "b", *KEYS), "left_anti").withColumn("nth", F.lit(0).cast("long"))
    again = rows.alias("a").join(repeated.alias("b"), _alike("a", "b", *KEYS), "left_semi")
    again = written(again.withColumn("part", F.spark_partition_id()), "mix-again")
    parts = again.groupBy(*KEYS, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select(*KEYS, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = again.withColumn("place", F.row_number().over(Window.partitionBy("part", *KEYS).orderBy("doc_id")))
    told = here.alias("a").join(parts.alias("b"), _alike("a", "b", "part", *KEYS)).select("a.*", (F.col("b.before") + F.col("a.place") - 1).alias("nth"))
    return once.unionByName(told.drop("part", "place"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = 7,
    text: str = "text",
    carry: bool = False,
    measure=binary_digits,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, expected, copies, taken) for each document; taken = copies * size.

    measure turns a size into a whole number, with few values, that a document's expected copies are in proportion to. With
    carry, also row: the document's own columns as one struct, so that no name can clash.
    """
    given = [F.col("doc_id"), F.col("source"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), word_count(F.col(text)).alias("size")]
    sized = lambda *more: docs.select(*given, *more).withColumn("measure", measure(F.col("size")).cast("long"))
    sizes = written(sized(), "mix-sizes")
    shares = written(targets(sizes, weights, max_repeat), "mix-shares")
    # Few rows beside the documents; the optimizer broadcasts them only below its threshold.
    cells = written(expected_copies(sizes, shares, max_repeat), "mix-cells")
    repeated = written(sizes.groupBy(*KEYS).count().where("count > 1").select(*KEYS), "mix-repeated")
    some = not repeated.isEmpty()
    u = uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "nth"), seed)
    p = F.greatest(F.least(F.col("chance"), F.lit(1.0 - 1e-9)), F.lit(1e-9))
    rank = (u / (1 - u)) / (p / (1 - p))

    def with_rank(rows: DataFrame) -> DataFrame:
        """Rank, and its cells, of what may be drawn; null for documents that have their whole copies only."""
        own = rows.alias("a").join(cells.alias("s"), _alike("a", "s", "source", "measure"))
        out = own.select("a.*", *[f"s.{c}" for c in ("source_size", "target", "expected", "certain", "chance", "rest")])
        out = out.withColumn("rank", F.when(F.col("chance") > 0, rank))
        out = out.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(float(2 ** (2 * CELL_BITS)))).cast("long"))
        return out.withColumn("coarse", F.shiftright("cell", CELL_BITS))

    numbers = numbered(sizes, repeated, some)
    ranked = with_rank(written(numbers, "mix-numbers") if some else numbers)
    open_rows = ranked.where("rank IS NOT NULL")

    def crossing(cells: DataFrame, key: str, start: Column) -> DataFrame:
        """Of each source the cell in which the running sum of words passes the rest, and the sum before it."""
        run = Window.partitionBy("source").orderBy(key)
        cells = cells.withColumn("before", start + F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        hit = cells.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        return hit.groupBy("source").agg(F.min(F.struct(key, "before")).alias("hit")).select("source", f"hit.{key}", "hit.before")

    first = crossing(open_rows.groupBy("source", "coarse").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "coarse", F.lit(0))
    first = written(first, "mix-coarse")
    inside = open_rows.alias("a").join(first.alias("b"), _alike("a", "b", "source", "coarse")).select("a.*", "b.before")
    fine = inside.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("base"))
    second = written(crossing(fine, "cell", F.col("base")), "mix-fine")
    # Only the last crossing cell of each source is put in order.
    last = open_rows.alias("a").join(second.alias("b"), _alike("a", "b", "source", "cell")).select("a.*", "b.before")
    place = ("rank", "doc_id", "digest", "nth")
    order = Window.partitionBy("source").orderBy(*place)
    run = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.select("source", *place, (2 * run + F.col("size") <= 2 * F.col("rest")).alias("drawn"))
    cut = written(last.groupBy("source").agg(F.max(F.when(F.col("drawn"), F.struct(*place))).alias("upto")), "mix-cut")

    # A source without a crossing cell takes all that may be drawn or, with nothing left to draw, none.
    rows = with_rank(numbered(sized(F.struct(*columns_of(docs)).alias("row")), repeated, some)) if carry else ranked
    out = (
        rows.alias("a")
        .join(second.select("source", F.col("cell").alias("cut_cell")).alias("b"), _alike("a", "b", "source"), "left")
        .join(cut.alias("c"), _alike("a", "c", "source"), "left")
    )
    here, upto = (F.struct(*[F.col(f"{side}.{c}") for c in place]) for side in ("a", "c.upto"))
    drawn = (
        F.when(F.col("rank").isNull() | (F.col("rest") <= 0), False)
        .when(F.col("cut_cell").isNull(), True)
        .when(F.col("cell") != F.col("cut_cell"), F.col("cell") < F.col("cut_cell"))
        .otherwise(F.coalesce(F.col("c.upto").isNotNull() & (here <= upto), F.lit(False)))
    )
    copies = (F.col("certain") + drawn.cast("long")).cast("long")
    return out.select("a.doc_id", "a.size", "a.source", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("a.size")).alias("taken"), *(["a.row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its own columns only."""
    rows = mix(docs, carry=True, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _all(tests) -> Column:
    out = F.lit(True)
    for x in tests:
        out = out & x
    return out
