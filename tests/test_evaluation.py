"""Regions, scores and ads against the plain model, and hand cases."""

import random

from pyspark.sql import functions as F

from boxsift.operators import regions as R
from boxsift.operators.evidence import evidence
from boxsift.plans.evaluate import evaluate
from boxsift.rules import RuleSet
from boxsift.sources.boxes import corners, from_text, read_requests, from_requests
from model import Box, ads, regions, score

TEXTS = ["医保卡高价回收", "微信 wxabc123", "电话13800138000", "收药", "搬家 开锁", "QQ:1234567", "取", "现", "保取现", "no 12", "医", "保", "联系 我", "提"]


def layout(seed: int, requests: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for r in range(requests):
        for i in range(rng.randint(1, 9)):
            x, y = rng.randrange(0, 500), rng.randrange(0, 600)
            out.append((r, i, rng.choice(TEXTS), x, y, x + rng.randrange(20, 160), y + rng.randrange(12, 50)))
    return out


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, block_index int, text string, x1 int, y1 int, x2 int, y2 int")
    return df.withColumns({"points": corners({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}), "confidence": F.lit(0.5)})


def test_model_agrees(spark):
    rows = layout(4)
    df = boxes(spark, rows)
    done = evaluate(df)
    by: dict[int, list[Box]] = {}
    for r, *rest in rows:
        by.setdefault(r, []).append(Box(*rest))
    found = {(r["request_id"], r["anchor"]): r["members"] for r in R.text_regions(R.nested(evidence(df)), RuleSet()).selectExpr("request_id", "inline(regions)").collect()}
    assert found == {(r, ids[0]): ids for r, bs in by.items() for _, ids, _ in regions(bs)}
    scores = sorted((r["request_id"], r["region"], r["risk_score"]) for r in done.regions.select("request_id", "region", "risk_score").collect())
    assert scores == sorted((r, k, score(items, bs)[0]) for r, bs in by.items() for k, (_, _, items) in enumerate(regions(bs)))
    got = sorted((a["request_id"], a["position"], a["ad_index"], tuple(a["block_indices"]), a["risk_score"], a["suspicious"]) for a in done.ads.collect())
    assert got == sorted((r, k, a["n"], tuple(a["ids"]), a["score"], a["bad"]) for r, bs in by.items() for k, a in enumerate(ads(bs)))


def told(spark, text):
    df = spark.createDataFrame([("a", text)], "id string, t string")
    return evaluate(from_text(df, "id", "t")).documents.first()


def test_hand_cases(spark):
    cases = {
        "收药": (18 + 23 + 12, True, ""),
        "13800138000": (24, False, ""),
        "13800138000 12345": (0, False, "no_groups"),
        "微信 wxabc123": (0, False, "all_groups_filtered"),
        "医\n保": (0, False, "no_groups"),
        "医保\n电话13800138000": (18 + 24 + 20, True, ""),
        "医保\n微信 wxabc123\n搬家": (45, True, ""),
    }
    df = spark.createDataFrame([(k, k) for k in cases], "id string, t string")
    got = {r["request_id"]: (r["risk_score"], r["suspicious"], r["empty_reason"]) for r in evaluate(from_text(df, "id", "t")).documents.collect()}
    assert got == cases
    # Boxes of one character make a word together, 取现; with no keyword box beside them there is no anchor at all.
    joined = told(spark, "取\n现\n医保")
    assert "取现" in joined["hit_keywords"] and "combo.medical_illegal" in joined["hit_rules"]
    assert told(spark, "取\n现")["empty_reason"] == "no_groups"
    two = spark.createDataFrame([("b", "13800138000 13900139000")], "id string, t string")
    assert evaluate(from_text(two, "id", "t")).documents.first()["phones"] == ["13800138000", "13900139000"]


def test_json_requests(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"request_id": "a", "ocr_blocks": [{"text": "收药", "points": [[0,0],[50,0],[50,20],[0,20]], "confidence": 0.9}]}\n'
        '{"ocr_text": "医保卡\\n\\n电话13800138000"}\n{"request_id": "c"}\nnot json\n'
    )
    docs = {r["request_id"]: r for r in evaluate(from_requests(read_requests(spark, str(tmp_path)))).documents.collect()}
    assert set(docs) == {"a", "rule-evaluate"}
    assert docs["a"]["risk_score"] == 53 and docs["rule-evaluate"]["phones"] == ["13800138000"]


def test_stream(spark, tmp_path):
    from boxsift.streaming import evaluate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"request_id": "a", "ocr_text": "收药"}\n')
    query = evaluate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["risk_score"] == 53


def test_stream_row_for_each_request(spark, tmp_path):
    """Requests without an id, with the same id, and without text each keep a row of their own."""
    from boxsift.streaming import evaluate_stream

    (tmp_path / "in").mkdir()
    lines = ['{"ocr_text": "收药"}', '{"ocr_text": "搬家"}', '{"request_id": "a", "ocr_text": "收药"}', '{"request_id": "a", "ocr_text": "收药"}', '{"request_id": "b", "ocr_text": " "}', '{"request_id": "c"}']
    (tmp_path / "in" / "1.json").write_text("\n".join(lines) + "\n")
    evaluate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["request_id"], r["n_blocks"], r["risk_score"]) for r in rows) == [("a", 1, 53), ("a", 1, 53), ("b", 0, 0), ("c", 0, 0), ("rule-evaluate", 1, 0), ("rule-evaluate", 1, 53)]
    assert len({r["request_key"] for r in rows}) == 6 and all(r["phones"] == [] and r["ads"] is not None for r in rows)


def test_unrelated_requests_change_nothing(spark):
    rows = layout(9, 12)
    alone = evaluate(boxes(spark, [r for r in rows if r[0] < 6])).documents.select("request_id", "risk_score", "hit_rules").collect()
    among = evaluate(boxes(spark, rows)).documents.where("request_id < 6").select("request_id", "risk_score", "hit_rules").collect()
    assert sorted(alone) == sorted(among)
