"""Evaluation of requests: evidence, regions, scores, ads, and what the document says as a whole."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.functions import geometry as G
from boxsift.functions.rows import bound
from boxsift.functions.text import has_contact_digits, phones, sorted_set, strip
from boxsift.operators import evidence as E
from boxsift.operators import regions as R
from boxsift.rules import RuleSet
from boxsift.sources.boxes import lines, own_boxes, request_name


#: What is told of a region; the boxes that it was worked out from stay behind.
REGION_FIELDS = ("anchor", "members", "x1", "y1", "x2", "y2", "attachments", "combined", "medical", "illegal", "phones", "wechat_ids", "qqs", "risk_score", "hit_rules")


@dataclass
class Evaluation:
    """What evaluate() finds; each table is planned when it is asked for."""

    found: DataFrame
    requests: DataFrame
    rules: RuleSet

    @cached_property
    def blocks(self) -> DataFrame:
        return E.annotations(self.found)

    @cached_property
    def regions(self) -> DataFrame:
        told = lambda r: F.struct(*[r[c].alias(c) for c in REGION_FIELDS])
        rows = self.requests.select("request_id", F.posexplode(F.transform("regions", told)).alias("region", "r"))
        return rows.select("request_id", "region", "r.*")

    @cached_property
    def ads(self) -> DataFrame:
        return self.requests.select("request_id", F.posexplode("ads").alias("position", "ad")).select("request_id", "position", "ad.*")

    @cached_property
    def nested(self) -> DataFrame:
        """Documents with their blocks: what later steps ask of a request, without another shuffle."""
        return documents(self.requests.withColumn("n_regions", F.size("regions")), self.rules)

    @cached_property
    def documents(self) -> DataFrame:
        return self.nested.drop("blocks")


def evaluate(boxes: DataFrame, rules: RuleSet | None = None, cards: DataFrame | None = None, signatures: DataFrame | None = None, images: DataFrame | None = None) -> Evaluation:
    """Evaluate boxes (request_id, block_index, text, points, x1, y1, x2, y2, confidence); one shuffle on the request, then
    rows alone. Cards (request_id, card, x1, y1, x2, y2), as card_candidates gives them, are regions ahead of those of the
    text; they are dealt out by the request too, as are signatures (request_id, block_index, mean, spread), the colours behind
    boxes, and images (request_id, image_width, image_height), which ads end with."""
    rules = rules or RuleSet()
    found = E.evidence(boxes, rules)
    requests = R.nested(found) if signatures is None else R.with_signatures(R.nested(found), signatures)
    requests = requests if images is None else requests.join(images.select("request_id", "image_width", "image_height"), "request_id", "left")
    requests = R.text_regions(requests, rules)
    requests = requests if cards is None else R.with_cards(requests, cards)
    return Evaluation(found, evaluate_rows(requests, rules), rules)


def evaluate_rows(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """Scores and ads of requests with blocks and regions; no shuffle."""
    return R.with_ads(R.scored(requests, rules), rules)


def documents(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """What a request says as a whole, of rows (request_id, blocks, ads, n_regions): its boxes' hits and its ads rolled up."""
    of = lambda c: F.flatten(F.transform("blocks", lambda b: b[c]))
    of_ads = lambda c: F.flatten(F.transform("ads", lambda a: a[c]))
    some = lambda c: F.exists("blocks", lambda b: F.size(b[c]) > 0)
    own = {"contact.phone": "phones", "contact.qq": "qqs", "contact.wechat": "wechat_ids", "illegal.keyword": "illegal_hits", "medical.keyword": "medical_hits"}
    noisy, worded = F.exists("blocks", lambda b: b["noise"]), F.exists("blocks", lambda b: b["keyword"])
    reason = F.when(F.size("ads") > 0, "").when(F.col("n_regions") == 0, "no_groups").when(some("phones") & ~worded, "phone_only_without_business_keywords").when(noisy, "noise_keywords").otherwise("all_groups_filtered")
    told = requests.select(
        "request_id",
        *[sorted_set(of(c)).alias(c) for c in ("phones", "wechat_ids", "qqs")],
        sorted_set(F.concat(of("medical_hits"), of("illegal_hits"), of_ads("hit_keywords"))).alias("hit_keywords"),
        sorted_set(F.concat(F.array_compact(F.array(*[F.when(some(c), F.lit(k)) for k, c in own.items()])), of_ads("hit_rules"))).alias("hit_rules"),
        F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("ocr_text"),
        F.size("blocks").cast("long").alias("n_blocks"),
        "ads",
        F.coalesce(F.array_max(F.transform("ads", lambda a: a["risk_score"])), F.lit(0)).alias("risk_score"),
        F.exists("ads", lambda a: a["suspicious"]).alias("suspicious"),
        reason.alias("empty_reason"),
        "blocks",
    )
    return told.withColumn("risk_level", R.level(F.col("risk_score"), rules))


def evaluate_text(rows: DataFrame, request_id: str, text: str, rules: RuleSet | None = None) -> DataFrame:
    """Documents of requests that come as text, as evaluate() gives them for its lines; without a shuffle.

    All lines lie at one point, so what evaluate() finds has a closed form: one region of all lines but pure noise, the
    first line with a keyword or contact ahead. A contact attaches if there is a keyword and no noise at all. A text
    without a line gives no row.
    """
    rules = rules or RuleSet()

    def line(t: Column, i: Column) -> Column:
        hits = E.hit_columns(t, rules)
        return F.struct(i.alias("block_index"), t.alias("text"), *[v.alias(k) for k, v in hits.items()])

    out = rows.select(F.col(request_id).alias("request_id"), F.transform(lines(F.col(text)), line).alias("blocks")).where("size(blocks) > 0")
    filled = lambda b, *cs: reduce(lambda x, y: x | y, [F.size(b[c]) > 0 for c in cs])
    contact = ("phones", "wechat_ids", "qqs")
    flags = lambda b: b.withField("keyword", filled(b, "medical_hits", "illegal_hits")).withField("contact", filled(b, *contact)).withField("noise", filled(b, "noise_hits"))
    out = out.withColumn("blocks", F.transform("blocks", flags))
    out = out.withColumn("blocks", F.transform("blocks", lambda b: b.withField("contact_like", b["contact"] | filled(b, "contact_hits") | has_contact_digits(b["text"]))))
    anchors = F.filter("blocks", lambda b: b["keyword"] | b["contact"])
    first = F.get(F.col("anchors"), F.lit(0))
    others = F.filter("blocks", lambda b: (b["block_index"] != first["block_index"]) & ~(b["noise"] & ~b["keyword"] & ~b["contact"]))
    out = out.withColumn("anchors", F.slice(anchors, 1, 1)).withColumn("n_regions", F.size("anchors"))
    out = out.withColumn("items", F.when(F.col("n_regions") > 0, F.concat("anchors", others)).otherwise(F.col("anchors"))).drop("anchors")
    attaches = F.exists("blocks", lambda b: b["keyword"]) & ~F.exists("blocks", lambda b: b["noise"])
    out = out.withColumn("accepted", F.filter("items", lambda b: b["contact_like"] & attaches))
    out = out.withColumn("read", F.transform("items", lambda b: strip(b["text"]))).withColumn("combined", F.array_join("read", ""))
    own = lambda c: F.flatten(F.transform("items", lambda b: b[c]))
    best = lambda c: F.coalesce(F.get(F.filter("accepted", lambda b: F.size(b[c]) > 0), F.lit(0))[c], F.array().cast("array<string>"))
    medical, illegal = R.combined_hits(F.col("combined"), F.col("read"), rules)
    out = out.withColumns(
        {
            "medical": sorted_set(F.concat(own("medical_hits"), medical)),
            "illegal": sorted_set(F.concat(own("illegal_hits"), illegal)),
            "phones": sorted_set(F.concat(best("phones"), phones(F.col("combined"), rules.phone_pattern))),
            "wechat_ids": best("wechat_ids"),
            "qqs": best("qqs"),
        }
    )
    r = {c: F.col(c) for c in ("medical", "illegal", "phones", "wechat_ids", "qqs", "risk_score", "hit_rules")}
    out = out.withColumns(R.region_score(r, rules))
    attached = F.transform("accepted", lambda b: b["block_index"])
    kept = F.filter("items", lambda b: ~b["contact_like"] | F.array_contains(attached, b["block_index"]))
    out = out.withColumn("base", kept).withColumn("base", F.when(F.size("base") > 0, F.col("base")).otherwise(F.col("items")))
    taken = F.transform("base", lambda b: b["block_index"])
    out = out.withColumn("boxes", F.concat("base", F.filter("blocks", lambda b: b["keyword"] & ~F.array_contains(taken, b["block_index"]))))
    point = {c: F.lit(0) for c in ("x1", "y1", "x2", "y2")}
    polygon = G.clipped_points(bound(R.upright(point), R.grown))
    ad = R.ad_of(r, F.col("boxes"), polygon, rules).withField("ad_index", F.lit(1))
    found = F.when(F.col("n_regions") > 0, F.array_compact(F.array(ad))).otherwise(F.array().cast(f"array<{R.AD}>"))
    return documents(out.select("request_id", "blocks", "n_regions", found.alias("ads")), rules).drop("blocks")


def evaluate_requests(requests: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """A document row for each of the keyed requests, with its request_key and its shown id; one without text has no blocks.

    Requests with boxes are evaluated over these, others over the lines of their text, without a shuffle.
    """
    rules = rules or RuleSet()
    boxed = F.coalesce(F.size("ocr_blocks"), F.lit(0)) > 0
    # The shown id travels with the key, so that documents need not meet their requests again.
    name = F.struct(F.col("request_key").cast("string").alias("request_key"), request_name(F.col("request_id")).alias("shown"))
    named = requests.withColumn("request_key", name)
    unread = F.size(lines(F.col("ocr_text"))) == 0
    told = evaluate(own_boxes(named.where(boxed), F.col("request_key")), rules).documents
    told = told.unionByName(evaluate_text(named.where(~boxed), "request_key", "ocr_text", rules))
    empty = {f.name: F.array().cast(f.dataType) for f in told.schema if f.dataType.typeName() == "array"}
    empty |= {"n_blocks": F.lit(0), "ocr_text": F.lit(""), "risk_score": F.lit(0), "risk_level": R.level(F.lit(0), rules), "suspicious": F.lit(False), "empty_reason": F.lit("no_groups")}
    none = named.where(~boxed & unread).select(F.col("request_key").alias("request_id"), *[v.cast(told.schema[c].dataType).alias(c) for c, v in empty.items()])
    rows = told.unionByName(none)
    return rows.select(F.col("request_id.request_key").alias("request_key"), F.col("request_id.shown").alias("request_id"), *told.columns[1:])
