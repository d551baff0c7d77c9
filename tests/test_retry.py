"""Focus frames against a plain version on turned boxes, views there and back, looks as a table, files sorted out and aged."""

import os
import random
import time
from math import cos, radians, sin

from pyspark.sql import functions as F

from boxsift.functions import geometry as G
from boxsift.operators import focus as X
from boxsift.operators import planning as P
from boxsift.operators import views as V
from boxsift.plans import retry as Y
from boxsift.plans.evaluate import evaluate
from boxsift.rules import RuleSet
from boxsift.sources.boxes import corners
from boxsift.sources.files import aged, sorted_out

RULES = RuleSet()
BOX = "request_id long, block_index int, text string, points array<array<int>>, confidence double"


def turned(x, y, w, h, a):
    c, s = cos(radians(a)), sin(radians(a))
    return [[round(x + u * c - v * s), round(y + u * s + v * c)] for u, v in ((0, 0), (w, 0), (w, h), (0, h))]


def framed(df):
    return df.withColumns(G.box_of_points(F.col("points")))


def test_round_trip(spark):
    """Points into every kind of view and back: within a pixel, whatever turn, mirror, scale or tilt the view has."""
    rng = random.Random(1)
    rows = []
    for k in range(40):
        x, y = rng.randrange(60, 300), rng.randrange(60, 300)
        card = turned(x, y, rng.randrange(60, 200), rng.randrange(50, 160), rng.choice((0, 10, -15, 20)))
        card[2] = [card[2][0] + rng.randrange(12), card[2][1] + rng.randrange(12)]
        rows.append((k, card, rng.choice(("card_candidate", "text_cluster")), float(rng.randrange(-20, 20)), [[x + 5, y + 7], [x + 40, y + 30]]))
    df = spark.createDataFrame(rows, "k int, card array<array<int>>, source string, angle double, p array<array<int>>")
    box = F.struct(F.lit(0).alias("card"), *[v.alias(c) for c, v in G.box_of_points(F.col("card")).items()], F.col("card").alias("points"))
    focus = F.struct(*[v.alias(c) for c, v in G.expanded(G.box_of_points(F.col("card")), 6, 4).items()], "angle", "source", box.alias("card"))
    df = df.withColumn("focus", focus)
    w, h = F.lit(640), F.lit(560)
    names = ("normal", "mirrored", "rotate_90", "rotate_180", "rotate_270", "deskew", "perspective")
    views = F.concat(F.array(*[V.focus_view(F.col("focus"), F.lit(n), w, h) for n in names]), V.rotation_views(w, h), V.card_views(F.array("focus.card")))
    out = df.select("k", "p", F.explode(views).alias("v")).where("v IS NOT NULL")
    out = out.select("k", "p", "v.name", "v.mirror", V.mapped_into(F.col("p"), F.col("v")).alias("there"), "v").withColumn("back", X.mapped_back(F.col("there"), F.col("v"))).collect()
    assert {r["name"] for r in out} == {*(f"focus_{n}" for n in names), "full_rotate_90", "full_rotate_180", "full_rotate_270", "pre_card_0"}
    for r in out:
        assert all(abs(a - b) <= 1 for p, q in zip(r["p"], r["back"]) for a, b in zip(p, q)), r
        assert r["there"] != r["p"]


def test_straightened_card(spark):
    """A card's corners, in order, are those of its straightened view."""
    df = spark.createDataFrame([([[100, 100], [300, 120], [290, 260], [90, 230]],)], "p array<array<int>>")
    v = df.select("p", V.warp(F.lit("c"), F.col("p"), 1.0).alias("v")).select("v", V.mapped_into(F.col("p"), F.col("v")).alias("q")).first()
    w, h = v["v"]["crop_width"], v["v"]["crop_height"]
    assert (w, h) == (202, 140)
    assert all(abs(a - b) < 1e-6 for p, q in zip(v["q"], [[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]]) for a, b in zip(p, q))
    line = spark.createDataFrame([([[0, 0], [5, 5], [9, 9], [20, 20]],)], "p array<array<int>>")
    assert line.select(V.warp(F.lit("c"), F.col("p"), 1.0).alias("v")).first()["v"] is None


def scene(spark):
    """1: text on a card that says little; 2: nothing to look at; 3: a turned scrap below the text; 4: no image size, no boxes of cards."""
    rows = [
        (1, 0, "保", turned(120, 130, 60, 20, 0), 0.9), (2, 0, "hello world text", turned(10, 10, 200, 20, 0), 0.9),
        (3, 0, "main heading line", turned(50, 50, 200, 20, 0), 0.9), (3, 1, "more text follows", turned(50, 90, 200, 20, 0), 0.9), (3, 2, "8", turned(60, 400, 60, 16, 30), 0.4),
        (4, 0, "医保卡高价回收", turned(50, 50, 200, 20, 0), 0.9), (4, 1, "保取现", turned(50, 90, 200, 20, 0), 0.9),
    ]
    boxes = framed(spark.createDataFrame(rows, BOX))
    cards = framed(spark.createDataFrame([(1, 0, turned(100, 100, 160, 100, 0))], "request_id long, card int, points array<array<int>>"))
    images = spark.createDataFrame([(i, 900, 1000) for i in (1, 2, 3, 4)], "request_id long, image_width int, image_height int")
    return boxes, cards, images


def test_plan_and_looks(spark):
    boxes, cards, images = scene(spark)
    plan = Y.planned(Y.analysed(boxes, cards, images, RULES), RULES, P.RetrySettings())
    got = {r["request_id"]: r for r in plan.collect()}
    assert [got[k]["reason"] for k in (1, 2, 3, 4)] == ["card_candidate_low_text_recall", "", "oblique_small_text", "high_risk_keywords_missing_contact"]
    assert got[1]["focus"]["source"] == "card_candidate" and got[3]["focus"]["source"] == "oblique_small_text" and got[2]["focus"] is None and got[2]["views"] == []
    assert [v["variant"] for v in got[1]["views"]] == ["normal", "rotate_180", "rotate_90", "rotate_270", "deskew"]
    assert abs(got[3]["focus"]["angle"]) > 0 or got[3]["focus"]["members"] == [2]
    # What a recogniser reads in the views: a phone number on the card of 1, nothing new in 3 and 4.
    view = next(v["view"] for v in got[1]["views"] if v["variant"] == "rotate_90")
    at = spark.createDataFrame([(turned(130, 160, 90, 18, 0),)], "p array<array<int>>").crossJoin(plan.where("request_id = 1").select(F.filter("views", lambda v: v["variant"] == "rotate_90")[0]["view"].alias("v")))
    points = at.select(V.mapped_into(F.col("p"), F.col("v")).alias("q")).first()["q"]
    assert view["quadrants"] == 1
    looks = spark.createDataFrame([(1, "rotate_90", 0, " 电话13800138000 ", points, 0.95), (1, "normal", 0, "  ", points, 0.9), (4, "normal", 0, "搬家 开锁", points, 0.9), (9, "normal", 0, "x", points, 0.9)], "request_id long, variant string, block_index int, text string, points array<array<double>>, confidence double")
    done = {r["request_id"]: r for r in Y.retried(plan.join(Y.gathered_looks(looks), "request_id", "left"), RULES).collect()}
    assert set(done) == {1, 2, 3, 4}
    one = done[1]
    assert one["selected"] and one["variant"] == "rotate_90" and one["added"] == 1 and one["retry_score"] > one["first_score"]
    assert [r["text"] for r in one["final"]] == ["保", "电话13800138000"] and all(abs(a - b) <= 1 for p, q in zip(one["final"][1]["points"], turned(130, 160, 90, 18, 0)) for a, b in zip(p, q))
    assert not done[2]["selected"] and done[2]["variant"] is None and done[2]["retry_score"] is None
    assert not done[3]["selected"] and done[3]["variant"] is not None and [r["text"] for r in done[3]["final"]][-1] == "8"
    assert not done[4]["selected"] and done[4]["retry_score"] <= done[4]["first_score"]


def test_retry_switched_off_and_empty(spark):
    boxes, cards, images = scene(spark)
    off = Y.planned(Y.analysed(boxes, None, images, RULES), RULES, P.RetrySettings(enabled=False))
    assert {(r["reason"], len(r["views"])) for r in off.collect()} == {("", 0)}
    none = Y.planned(Y.analysed(boxes.limit(0), cards, images, RULES), RULES, P.RetrySettings())
    assert Y.retried(none.withColumn("looks", F.lit(None).cast(f"array<{Y.LOOK}>")), RULES).isEmpty()


def test_ads_of_turned_boxes_end_with_the_image(spark):
    rows = [(1, 0, "医保卡高价回收", turned(200, 100, 160, 24, 20), 0.9), (1, 1, "保取现", turned(190, 130, 160, 24, 20), 0.9)]
    boxes = framed(spark.createDataFrame(rows, BOX))
    images = spark.createDataFrame([(1, 360, 150)], "request_id long, image_width int, image_height int")
    free, held = evaluate(boxes).ads.first(), evaluate(boxes, images=images).ads.first()
    a, b = free["points"][0], free["points"][1]
    assert abs((b[1] - a[1]) / (b[0] - a[0]) - 0.364) < 0.03  # along the text: tan 20
    assert (held["x2"], held["y2"]) == (359, 149) and free["x2"] > 359 and held["x1"] == free["x1"]


def test_signatures(spark):
    """A contact on another ground does not attach, one on the same ground does; unknown grounds count half."""
    rows = [(k, i, t, 100, 100 + 40 * i, 220, 124 + 40 * i) for k in (1, 2, 3) for i, t in enumerate(("医保卡高价回收", "微信 wxabc123"))]
    df = spark.createDataFrame(rows, "request_id long, block_index int, text string, x1 int, y1 int, x2 int, y2 int")
    df = df.withColumns({"points": corners({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}), "confidence": F.lit(0.5)})
    colours = [(1, 0, [10.0] * 3, [5.0] * 3), (1, 1, [10.0] * 3, [5.0] * 3), (2, 0, [10.0] * 3, [5.0] * 3), (2, 1, [200.0] * 3, [60.0] * 3), (3, 0, [10.0] * 3, [5.0] * 3)]
    signatures = spark.createDataFrame(colours, "request_id long, block_index int, mean array<double>, spread array<double>")
    got = {r["request_id"]: r["attachments"][0] for r in evaluate(df, signatures=signatures).regions.where("region = 0").collect()}
    assert [got[k]["background"] for k in (1, 2, 3)] == [1.0, 0.0, 0.5] and got[1]["reason"] == "" and got[2]["reason"] == "background_mismatch"
    assert got[1]["score"] > got[3]["score"] > got[2]["score"]
    plain = {r["request_id"]: r["attachments"][0]["score"] for r in evaluate(df).regions.where("region = 0").collect()}
    assert plain[3] == got[3]["score"]


def test_files(spark, tmp_path):
    good = '{"request_id": "a", "ocr_blocks": [{"text": "收药", "points": [[0,0],[5,0],[5,2],[0,2]], "confidence": 0.9}]}'
    lines = [good, '{"ocr_text": "x"}', "{not json", '{"request_id": "b"}', '{"ocr_text": ""}', '{"ocr_blocks": [{"points": [[0,0]], "confidence": 0.9}]}', '{"ocr_blocks": [{"text": "x", "points": [[0]]}]}', '{"ocr_blocks": [{"text": "x"}]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(lines[:4]) + "\n")
    (tmp_path / "in" / "2.json").write_text("\n".join(lines[4:]) + "\n")
    got = sorted_out(spark, str(tmp_path / "in")).collect()
    assert len(got) == len(lines)
    assert sorted((r["rejected"] or "", r["file"]) for r in got) == sorted([("", "1.json"), ("", "1.json"), ("malformed", "1.json"), ("no_content", "1.json"), ("no_content", "2.json"), ("no_box_text", "2.json"), ("bad_points", "2.json"), ("bad_points", "2.json")])
    old = time.time() - 25 * 3600
    os.utime(tmp_path / "in" / "1.json", (old, old))
    (tmp_path / "in" / "sub").mkdir()
    files = {r["file"]: r["expired"] for r in aged(spark, str(tmp_path / "in")).collect()}
    assert files == {"1.json": True, "2.json": False}
    assert {r["expired"] for r in aged(spark, str(tmp_path / "in"), hours=26).collect()} == {False}


def test_rules_from_a_file(tmp_path):
    (tmp_path / "rules.yaml").write_text("medical_keywords: [甲, 乙]\nmedical_aliases:\n  甲: [丙]\nscores:\n  phone: 5\nsuspicious_score: 50\nunknown: 1\n", encoding="utf-8")
    rules = RuleSet.load(str(tmp_path / "rules.yaml"))
    assert rules.medical_keywords == ("甲", "乙") and rules.medical_aliases == {"甲": ("丙",)} and rules.suspicious_score == 50
    assert rules.weight("phone") == 5 and rules.weight("wechat") == 18 and rules.illegal_keywords == RuleSet().illegal_keywords
    (tmp_path / "none.yaml").write_text("", encoding="utf-8")
    assert RuleSet.load(str(tmp_path / "none.yaml")) == RuleSet()
