"""Cards found in an image: which candidates count, and the boxes that lie on a card. Pixels stay outside.

Candidates are rows; they are thinned by windows over the request, and met with boxes by a join on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxsift.functions import geometry as G

# Bounds on a candidate's area and sides beside the image's, its longest shape, the grid on which two are one, and how many count.
LEAST_AREA, MOST_AREA, MOST_SIDE, LEAST_SIDE, LONGEST, GRID, MOST_CARDS = 0.0012, 0.35, 0.9, 28, 6.5, 12, 12


def card_candidates(found: DataFrame) -> DataFrame:
    """Of found (request_id, ordinal, x, y, w, h, area, width, height), in the order of ordinal: the cards (request_id, card,
    x1, y1, x2, y2), largest first, the first of equals; card counts from 0."""
    c = F.col
    size = c("width") * c("height")
    fits = c("area").between(size * LEAST_AREA, size * MOST_AREA) & (c("w") >= LEAST_SIDE) & (c("h") >= LEAST_SIDE) & (c("w") <= c("width") * MOST_SIDE) & (c("h") <= c("height") * MOST_SIDE)
    free = (c("x") > 1) & (c("y") > 1) & (c("x") + c("w") < c("width") - 1) & (c("y") + c("h") < c("height") - 1)
    shape = F.greatest(c("w") / F.greatest(c("h"), F.lit(1)), c("h") / F.greatest(c("w"), F.lit(1))) <= LONGEST
    cell = [F.floor(v / GRID).alias(n) for n, v in {"_a": c("x"), "_b": c("y"), "_c": c("x") + c("w"), "_d": c("y") + c("h")}.items()]
    rows = found.where(fits & free & shape).select("*", *cell)
    first = Window.partitionBy("request_id", "_a", "_b", "_c", "_d").orderBy("ordinal")
    largest = Window.partitionBy("request_id").orderBy(F.desc(c("w") * c("h")), "ordinal")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("card", F.row_number().over(largest) - 1).where(c("card") < MOST_CARDS)
    return rows.select("request_id", "card", c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))


def on_card(card, box):
    """A box lies on a card if its center does, or it touches it, with an eighth of each side around, 10 pixels at least."""
    pad = lambda lo, hi: F.greatest(F.lit(10), F.floor((card[hi] - card[lo]) / 8).cast("int"))
    wide, (x, y) = G.expanded(card, pad("x1", "x2"), pad("y1", "y2")), G.center(box)
    return G.contains_point(wide, x, y) | G.intersects(wide, box)


def gathered(cards: DataFrame) -> DataFrame:
    """(request_id, cards) of cards (request_id, card, x1, y1, x2, y2): one row for each request, cards in order."""
    return cards.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("card", "x1", "y1", "x2", "y2"))).alias("cards"))
