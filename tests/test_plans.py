"""What a query works out stands once in its plan: no filter repeats the folds of the projection above it."""

import random

import pytest
from helpers import SF
from pyspark.sql import functions as F

from boxsift.functions import text as T
from boxsift.operators import planning as P
from boxsift.operators import selection as S
from boxsift.queries import QUERIES, RULES, evaluated


def lines(spark, name, node):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.split("\n") if x.lstrip(" :+-").startswith(node)]


@pytest.mark.parametrize("name", ["focus_regions", "draw_commands", "ad_polygons"])
def test_no_fold_in_a_filter(spark, name):
    assert not [x for x in lines(spark, name, "Filter") if "aggregate(" in x]


def test_boxes_are_read_once(spark):
    assert len(lines(spark, "draw_commands", "Relation")) == 1


def test_similar_names_meet_without_lambdas(spark):
    joins = lines(spark, "similar_part_names", "Join")
    assert joins and not [x for x in joins if "lambda" in x]


def test_coded_texts_are_similar_alike(spark):
    """Packed words and sets behind them say what is_similar says: short, long, within one another, beyond the first plane."""
    rng = random.Random(4)
    texts = ["", "a", "ab", "ba", "abc", "xabc", "\U00020000bc", "\U00020000b", "abd"]
    for n in (3, 5, 14, 23, 24, 25, 31, 60):
        one = [rng.choice("abc保\U00020001") for _ in range(n)]
        texts += ["".join(one), "".join(one[1:])]
        for share in (0.2, 0.33, 0.36, 0.5):
            texts += ["".join(c if rng.random() > share else rng.choice("xyz") for c in one + list("12")[: rng.randrange(3)])]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = rows.select("t", T.coded(F.col("t")).alias("c")).select("t", "c.*")
    a, b = rows.alias("a"), rows.alias("b")
    of = lambda side: {c: F.col(f"{side}.{c}") for c in rows.columns}
    told = a.crossJoin(b).select("a.t", F.col("b.t").alias("u"), T.is_similar(F.col("a.t"), F.col("b.t")).alias("x"), T.is_similar_coded(of("a"), of("b")).alias("y")).collect()
    assert [r for r in told if r.x != r.y] == []
    assert {r.x for r in told} == {True, False}


def test_frames_are_looked_for_where_due(spark):
    """Requests that are not due have no frame, and the others the one that they have without the gate."""
    rows = focused_features(spark).withColumn("due", F.col("request_id") % 2 == 0)
    free = {r.request_id: r.focus for r in S.with_focus(rows, RULES).select("request_id", "focus").collect()}
    gated = {r.request_id: r.focus for r in S.with_focus(rows, RULES, F.col("due")).select("request_id", "focus").collect()}
    assert gated == {k: v if k % 2 == 0 else None for k, v in free.items()}
    assert any(gated.values()) and any(v for k, v in free.items() if k % 2)


def focused_features(spark):
    rows = evaluated(spark, SF).nested.where("request_id < 60")
    rows = S.with_card_lists(rows, None).withColumns({"image_width": F.lit(900), "image_height": F.lit(1000)})
    return P.round_features(rows, F.size("cards") > 0, RULES)


def test_json_requests_meet_no_join(spark):
    assert not lines(spark, "json_requests", "Join") and len(lines(spark, "json_requests", "Relation")) == 3
