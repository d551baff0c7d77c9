"""Regions of boxes around anchors, their members, contacts and scores, and the fold that drops duplicate regions.

A request is one row with its boxes in one array and its regions in another, so everything below happens within a row
after one shuffle on the request; steps add fields to the regions, and order-dependent ones are folds. The folds look at
pairs of a request's boxes or regions: their cost grows with the square of the boxes of one request, not of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.functions import geometry as G
from boxsift.functions import text as T
from boxsift.functions.rows import bound
from boxsift.operators import evidence as E
from boxsift.operators.cards import gathered, on_card
from boxsift.rules import RuleSet

CORE_DISTANCE, CLUSTER_DISTANCE, NOISE_DISTANCE, ATTACHED = 90, 80, 85, 0.55
REGION = "struct<anchor:int,members:array<int>,x1:int,y1:int,x2:int,y2:int>"


def nested(found: DataFrame) -> DataFrame:
    """(request_id, blocks) of evidence, blocks in order with what the later steps ask of a box."""
    box = F.struct(
        "block_index", "text", "x1", "y1", "x2", "y2", "confidence", *E.HIT_COLUMNS,
        G.angle(F.col("points")).alias("angle"),
        F.when(~G.is_level(F.col("points")), F.col("points").cast("array<array<int>>")).alias("corners"),
        E.has_keyword().alias("keyword"),
        E.has_contact().alias("contact"),
        E.is_contact_like().alias("contact_like"),
        E.some("noise_hits").alias("noise"),
    )
    return found.groupBy("request_id").agg(F.array_sort(F.collect_list(box)).alias("blocks"))


def with_signatures(requests: DataFrame, signatures: DataFrame) -> DataFrame:
    """Gives blocks the colours behind them, of signatures (request_id, block_index, mean, spread: three numbers each): a field
    signature, null where there is none. They are gathered by request and met in its row."""
    one = F.struct("block_index", F.struct(*[F.col(c).cast("array<double>").alias(c) for c in ("mean", "spread")]).alias("signature"))
    told = signatures.groupBy("request_id").agg(F.map_from_entries(F.collect_list(one)).alias("_signatures"))
    blocks = F.transform("blocks", lambda b: b.withField("signature", F.element_at("_signatures", b["block_index"])))
    return requests.join(told, "request_id", "left").withColumn("blocks", blocks).drop("_signatures")


def same_background(a: Column, b: Column) -> Column:
    """How alike two signatures are, in whole ten-thousandths; half where one is missing."""
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(a[c], b[c], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    alike = 1 - F.least(F.lit(1.0), gap("mean") / 100 * 0.75 + gap("spread") / 60 * 0.25)
    return F.when(a.isNull() | b.isNull(), F.lit(5000)).otherwise(F.rint(F.greatest(F.lit(0.0), alike) * 10_000).cast("int"))


def blocks_of(readings: Column, rules: RuleSet) -> Column:
    """Readings (text, confidence, x1, y1, x2, y2, points) as the blocks that nested gives, numbered in their order."""
    fields = ("medical_hits", "illegal_hits", "phones", "wechat_ids", "qqs", "contact_hits", "noise_hits")

    def block(r: Column, k: Column) -> Column:
        return bound({"r": r, "k": k.cast("int"), **E.hit_columns(r["text"], rules)}, told)

    def told(t: Column) -> Column:
        r, some = t["r"], {c: F.size(t[c]) > 0 for c in fields}
        contact = some["phones"] | some["wechat_ids"] | some["qqs"]
        flags = {
            "angle": G.angle(r["points"]),
            "corners": F.when(~G.is_level(r["points"]), r["points"]),
            "keyword": some["medical_hits"] | some["illegal_hits"],
            "contact": contact,
            "contact_like": contact | some["contact_hits"] | T.has_contact_digits(r["text"]),
            "noise": some["noise_hits"],
        }
        return F.struct(t["k"].alias("block_index"), *[r[c].alias(c) for c in ("text", "x1", "y1", "x2", "y2", "confidence")], *[t[c].alias(c) for c in E.HIT_COLUMNS], *[v.alias(c) for c, v in flags.items()])

    return F.transform(readings, block)


def bounds(boxes: Column) -> dict[str, Column]:
    low = lambda c: F.array_min(F.transform(boxes, lambda b: b[c]))
    high = lambda c: F.array_max(F.transform(boxes, lambda b: b[c]))
    return {"x1": low("x1"), "y1": low("y1"), "x2": high("x2"), "y2": high("y2")}


def whole(x: Column) -> Column:
    return x.cast("int")


def _same_boxes(a: Column, b: Column) -> Column:
    """Shared boxes reach half of the smaller side, one at least."""
    half = F.greatest(F.lit(1), whole(F.floor(F.least(F.size(a), F.size(b)) / 2)))
    return F.size(F.array_intersect(a, b)) >= half


def text_regions(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds regions: around each anchor that no earlier region used, unless the region repeats a kept one."""

    def around(a: Column) -> Column:
        width, height = F.greatest(F.lit(20), a["x2"] - a["x1"]), F.greatest(F.lit(20), a["y2"] - a["y1"])
        limit_x = F.greatest(F.lit(70), whole(width * rules.group_limit_x_ratio))
        limit_y = F.greatest(F.lit(120), whole(height * rules.group_limit_y_ratio))
        (ax, ay) = G.center(a)

        def near(b: Column) -> Column:
            bx, by = G.center(b)
            quiet = b["noise"] & ~b["keyword"] & ~b["contact"]
            return (b["block_index"] != a["block_index"]) & ~quiet & (F.abs(bx - ax) <= limit_x) & (F.abs(by - ay) <= limit_y)

        return F.struct(a["block_index"].alias("anchor"), F.concat(F.array(a), F.filter("blocks", near)).alias("boxes"))

    def framed(c: Column) -> Column:
        b = bounds(c["boxes"])
        dx = F.greatest(F.lit(rules.min_region_padding), whole((b["x2"] - b["x1"]) * rules.region_padding_x_ratio))
        dy = F.greatest(F.lit(rules.min_region_padding), whole((b["y2"] - b["y1"]) * rules.region_padding_y_ratio))
        frame = G.expanded(b, dx, dy)
        return F.struct(c["anchor"].alias("anchor"), F.transform(c["boxes"], lambda x: x["block_index"]).alias("members"), *[v.alias(k) for k, v in frame.items()])

    def keep(state: Column, r: Column) -> Column:
        repeats = F.exists(state["kept"], lambda k: (G.iou(k, r) >= 0.35) | _same_boxes(k["members"], r["members"]))
        kept = F.when(repeats, state["kept"]).otherwise(F.concat(state["kept"], F.array(r)))
        return F.struct(F.array_union(state["used"], r["members"]).alias("used"), kept.alias("kept"))

    def step(state: Column, a: Column) -> Column:
        """Boxes are looked through for anchors only that no region has used."""
        region = bound({"c": around(a)}, lambda t: bound({"r": framed(t["c"]).cast(REGION)}, lambda u: keep(state, u["r"])))
        return F.when(F.array_contains(state["used"], a["block_index"]), state).otherwise(region)

    anchors = F.filter("blocks", lambda b: b["keyword"] | b["contact"])
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{REGION}>").alias("kept"))
    return requests.withColumn("regions", F.aggregate(anchors, start, step)["kept"])


def with_cards(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Puts ahead of the regions those of cards (request_id, card, x1, y1, x2, y2) that hold a box: all boxes on the card."""
    return with_card_regions(requests.join(gathered(cards), "request_id", "left")).drop("cards")


def with_card_regions(requests: DataFrame) -> DataFrame:
    """The same for requests that have their cards in an array."""
    held = lambda k: F.transform(F.filter("blocks", lambda b: on_card(k, b)), lambda b: b["block_index"])
    region = lambda k: F.struct(F.lit(None).cast("int").alias("anchor"), held(k).alias("members"), *[k[c].alias(c) for c in ("x1", "y1", "x2", "y2")]).cast(REGION)
    of_cards = F.filter(F.coalesce(F.transform("cards", region), F.array().cast(f"array<{REGION}>")), lambda r: F.size(r["members"]) > 0)
    return requests.withColumn("regions", F.concat(of_cards, "regions"))


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def turned(a: Column, b: Column) -> Column:
    """Difference of two angles, at most a quarter turn apart."""
    d = F.abs(a - b)
    return F.least(d, F.abs(d - 90))


def with_fields(requests: DataFrame, **fields) -> DataFrame:
    """requests with fields added to each struct of regions; a field is given as a function of the region."""

    def added(r: Column) -> Column:
        out = r
        for name, f in fields.items():
            out = out.withField(name, f(r))
        return out

    return requests.withColumn("regions", F.transform("regions", added))


def with_contacts(requests: DataFrame) -> DataFrame:
    """Adds cores and attachments (block_index, score, background, reason, ...) to regions with items, and accepted, those that
    score enough. The background is told from the blocks' signatures where they have any."""
    signed = "signature" in requests.schema["blocks"].dataType.elementType.names
    out = with_fields(requests, words=lambda r: F.filter(r["items"], lambda b: b["keyword"]))

    def cores(r: Column) -> Column:
        close = lambda b: F.exists(r["words"], lambda c: G.distance(b, c) <= CORE_DISTANCE)
        beside = F.filter(r["items"], lambda b: ~b["keyword"] & ~b["noise"] & ~b["contact"] & close(b))
        return F.concat(r["words"], beside)

    out = with_fields(out, cores=cores)

    def diagonal(r: Column) -> Column:
        frame = bounds(r["cores"])
        return F.greatest(F.lit(1.0), F.hypot((frame["x2"] - frame["x1"]).cast("double"), (frame["y2"] - frame["y1"]).cast("double")))

    def mean(f):
        total = lambda r: F.aggregate(r["cores"], F.lit(0.0), lambda acc, c: acc + f(c))
        return lambda r: F.when(F.size(r["cores"]) > 0, F.try_divide(total(r), F.size(r["cores"])))

    out = with_fields(
        out,
        diag=diagonal,
        core_angle=lambda r: median(F.transform(r["cores"], lambda c: c["angle"])),
        core_x=mean(lambda c: G.center(c)[0]),
        core_y=mean(lambda c: G.center(c)[1]),
    )

    def background(r: Column, c: Column) -> Column:
        if not signed:
            return F.lit(0.5)
        total = F.aggregate(r["cores"], F.lit(0).cast("long"), lambda s, k: s + same_background(c["signature"], k["signature"]))
        return F.rint(total / F.size(r["cores"])) / 10_000

    def attach(r: Column, c: Column, noise: Column) -> Column:
        return bound({"c": c, "background": background(r, c), "off": turned(c["angle"], r["core_angle"])}, lambda t: attached(r, t, noise))

    def attached(r: Column, t: Column, noise: Column) -> Column:
        c, off = t["c"], t["off"]
        return bound({"c": c, "off": off, "background": t["background"], **parts(r, c, off, t["background"], noise)}, judged)

    def judged(t: Column) -> Column:
        c = t["c"]
        reason = F.when(t["noisy"] & (t["score"] < 0.6), "noise_nearby").when(t["off"] > 25, "angle_mismatch").when(t["background"] < 0.45, "background_mismatch").when(t["score"] < ATTACHED, "low_attachment_score").otherwise("")
        return F.struct(t["score"].alias("score"), *[c[k].alias(k) for k in ("block_index", "phones", "wechat_ids", "qqs")], t["background"].alias("background"), reason.alias("reason"))

    def parts(r: Column, c: Column, off: Column, behind: Column, noise: Column) -> dict[str, Column]:
        align = F.when(off <= 12, 1.0).when(off <= 25, 0.65).otherwise(0.2)
        nearest = F.array_min(F.transform(r["cores"], lambda k: G.distance(c, k)))
        x, y = G.center(c)
        below = (y >= r["core_y"] - 20) & (F.abs(x - r["core_x"]) <= F.greatest(F.lit(60.0), r["diag"] * 0.4))
        noisy = c["noise"] | F.exists(noise, lambda b: (b["block_index"] != c["block_index"]) & (G.distance(c, b) <= NOISE_DISTANCE))
        raw = (
            align * 0.24
            + behind * 0.24
            + F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), nearest / r["diag"])) * 0.20
            + F.when(nearest <= CLUSTER_DISTANCE, 1.0).otherwise(0.35) * 0.16
            + F.when(below, 0.8).otherwise(0.4) * 0.16
            - F.when(noisy, 0.35).otherwise(0.0)
        )
        return {"noisy": noisy, "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)}

    likely = lambda r: F.filter(r["items"], lambda b: b["contact_like"] & (F.size(r["cores"]) > 0))
    out = with_fields(out, attachments=lambda r: bound({"noise": F.filter("blocks", lambda b: b["noise"])}, lambda t: F.transform(likely(r), lambda c: attach(r, c, t["noise"]))))
    return with_fields(out, accepted=lambda r: F.filter(r["attachments"], lambda a: a["score"] >= ATTACHED))


def best_contacts(r: Column, kind: str) -> Column:
    """Values of a region's best accepted contact that has the kind; the first of equals."""
    having = F.filter(r["accepted"], lambda a: F.size(a[kind]) > 0)
    ranked = F.transform(having, lambda a, k: F.struct((-a["score"]).alias("s"), k.alias("k"), a[kind].alias("v")))
    return F.coalesce(F.array_min(ranked)["v"], F.array().cast("array<string>"))


def combined_hits(text: Column, singles: Column, rules: RuleSet) -> tuple[Column, Column]:
    """Medical and illegal words of a region's joined text; some follow from two boxes of one character."""
    single = lambda c: F.array_contains(singles, c)
    inferred = F.array_compact(F.array(F.when(single("取") & single("现"), F.lit("取现")), F.when(single("提") & single("现"), F.lit("提现"))))
    return T.word_hits(text, rules.medical_keywords, rules.medical_aliases), F.concat(T.word_hits(text, rules.illegal_keywords, rules.illegal_aliases), inferred)


def scored(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds to each region its words, contacts, rules and score, and the boxes that make up its ad."""
    out = with_fields(requests, items=lambda r: F.transform(r["members"], lambda i: F.get("blocks", i)))
    out = with_contacts(out)
    placed = lambda b, k: F.struct(G.center(b)[1].alias("y"), b["x1"].alias("x"), k.alias("k"), T.strip(b["text"]).alias("t"))
    out = with_fields(out, read=lambda r: F.transform(F.array_sort(F.transform(r["items"], placed)), lambda b: b["t"]))
    out = with_fields(out, combined=lambda r: F.array_join(r["read"], ""))
    own = lambda r, c: F.flatten(F.transform(r["items"], lambda b: b[c]))
    told = lambda r: combined_hits(r["combined"], r["read"], rules)
    out = with_fields(
        out,
        medical=lambda r: T.sorted_set(F.concat(own(r, "medical_hits"), told(r)[0])),
        illegal=lambda r: T.sorted_set(F.concat(own(r, "illegal_hits"), told(r)[1])),
        phones=lambda r: T.sorted_set(F.concat(best_contacts(r, "phones"), T.phones(r["combined"], rules.phone_pattern))),
        wechat_ids=lambda r: best_contacts(r, "wechat_ids"),
        qqs=lambda r: best_contacts(r, "qqs"),
    )
    return with_fields(out, **{k: (lambda r, k=k: region_score(r, rules)[k]) for k in ("risk_score", "hit_rules")})


def region_score(r, rules: RuleSet) -> dict[str, Column]:
    """Score and rule names from r's medical, illegal, phones, wechat_ids and qqs."""
    w = rules.weight
    has = {c: F.size(r[c]) > 0 for c in ("medical", "illegal", "phones", "wechat_ids", "qqs")}
    contact = has["phones"] | has["wechat_ids"] | has["qqs"]
    parts = [
        ("medical.keyword", has["medical"], F.least(F.lit(w("medical_cap")), w("medical_base") + F.size(r["medical"]) * w("medical_per_hit"))),
        ("illegal.keyword", has["illegal"], F.least(F.lit(w("illegal_cap")), w("illegal_base") + F.size(r["illegal"]) * w("illegal_per_hit"))),
        ("contact.phone", has["phones"], F.lit(w("phone"))),
        ("contact.wechat", has["wechat_ids"], F.lit(w("wechat"))),
        ("contact.qq", has["qqs"], F.lit(w("qq"))),
        ("combo.medical_contact", has["medical"] & contact, F.lit(w("medical_with_contact"))),
        ("combo.medical_illegal", has["medical"] & has["illegal"], F.lit(w("medical_illegal_combo"))),
        ("combo.multi_illegal", F.size(r["illegal"]) >= 2, F.lit(w("illegal_multi_bonus"))),
    ]
    total = F.lit(0)
    for _, test, points in parts:
        total = total + F.when(test, points).otherwise(0)
    total = F.when(has["medical"], F.greatest(total, F.lit(rules.suspicious_score))).otherwise(total)
    names = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test, _ in parts])))
    return {"risk_score": F.least(total, F.lit(100)), "hit_rules": names}


def level(score: Column, rules: RuleSet) -> Column:
    return F.when(score >= rules.high_risk_score, "high").when(score >= rules.suspicious_score, "medium").otherwise("low")


def members(requests: DataFrame) -> DataFrame:
    """Adds ad_boxes: the region's boxes without contacts that do not attach, and keyword boxes close by."""

    def base(r: Column) -> Column:
        attached = F.transform(r["accepted"], lambda a: a["block_index"])
        return F.filter(r["items"], lambda b: ~b["contact_like"] | F.array_contains(attached, b["block_index"]))

    out = with_fields(requests, base=base)
    out = with_fields(out, base=lambda r: F.when(F.size(r["base"]) > 0, r["base"]).otherwise(r["items"]))

    def wide(r: Column) -> Column:
        frame = bounds(r["base"])
        pad = lambda a, b: F.greatest(F.lit(40), whole(F.greatest(F.lit(40), frame[b] - frame[a]) * 0.35))
        return F.struct(*[v.alias(k) for k, v in G.expanded(frame, pad("x1", "x2"), pad("y1", "y2")).items()])

    angles = lambda r: F.transform(F.filter(r["base"], lambda b: b["keyword"]), lambda b: b["angle"])
    out = with_fields(out, wide=wide, base_angle=lambda r: F.coalesce(median(angles(r)), F.lit(0.0)), taken=lambda r: F.transform(r["base"], lambda b: b["block_index"]))

    def joins(r: Column, b: Column) -> Column:
        x, y = G.center(b)
        inside = G.contains_point(r["wide"], x, y) | G.intersects(r["wide"], b)
        return b["keyword"] & ~F.array_contains(r["taken"], b["block_index"]) & inside & (turned(b["angle"], r["base_angle"]) <= 25)

    return with_fields(out, ad_boxes=lambda r: F.concat(r["base"], F.filter("blocks", lambda b: joins(r, b))))


def corner_cloud(boxes: Column) -> Column:
    """The corners of all boxes, as arrays (x, y)."""
    return F.flatten(F.transform(boxes, lambda b: F.coalesce(b["corners"], G.corners_of(b))))


def refined(boxes: Column, region) -> Column:
    """Corners of the smallest rectangle around the boxes' corners, grown: sides of 24 at least, times 1.55 and 1.8. Fewer than
    four corners in all leave the region's own frame."""
    level = (F.size(boxes) == 1) & F.get(boxes, F.lit(0))["corners"].isNull()  # no hull is needed
    alone = bound({"b": F.get(boxes, F.lit(0))}, lambda t: bound(upright(t["b"]), grown))
    around = lambda t: F.when(F.size(t["p"]) < 4, G.corners_of(region)).otherwise(bound({"r": G.smallest_rectangle(t["p"])}, lambda r: grown(r["r"])))
    return F.when(level, alone).otherwise(bound({"p": corner_cloud(boxes)}, around))


def upright(b) -> dict[str, Column]:
    """A level box as smallest_rectangle gives it."""
    (x, y) = G.center(b)
    whole_numbers = {"width": b["x2"] - b["x1"], "height": b["y2"] - b["y1"], "ux": F.lit(1), "uy": F.lit(0), "length": F.lit(1)}
    return {"center_x": x, "center_y": y, **{k: v.cast("double") for k, v in whole_numbers.items()}}


def grown(r: Column) -> Column:
    return G.rectangle_corners(r, F.greatest(r["width"], F.lit(24.0)) * 1.55, F.greatest(r["height"], F.lit(24.0)) * 1.8)


AD = (
    "struct<ad_index:int,points:array<array<int>>,x1:int,y1:int,x2:int,y2:int,block_indices:array<int>,hit_keywords:array<string>,hit_rules:array<string>,"
    "phones:array<string>,wechat_ids:array<string>,qqs:array<string>,risk_score:int,risk_level:string,suspicious:boolean>"
)


AD_FIELDS = ("points", "x1", "y1", "x2", "y2", "block_indices", "hit_keywords", "hit_rules", "phones", "wechat_ids", "qqs", "risk_score", "risk_level", "suspicious")


def ad_of(r, boxes: Column, polygon: Column, rules: RuleSet) -> Column:
    """A region as an ad of boxes within a polygon, as yet without a number; null without a signal."""
    signal = (F.size(r["medical"]) > 0) | (F.size(r["illegal"]) > 0) | (F.size(r["phones"]) > 0) | (F.size(r["wechat_ids"]) > 0) | (F.size(r["qqs"]) > 0) | (r["risk_score"] > 0)
    suspicious = (r["risk_score"] >= rules.suspicious_score) | ((F.size(r["medical"]) > 0) & (F.size(r["illegal"]) > 0))

    def ad(t: Column) -> Column:
        return F.struct(
            F.lit(0).alias("ad_index"),
            t["points"].alias("points"),
            *[v.alias(k) for k, v in G.box_of_points(t["points"]).items()],
            F.transform(boxes, lambda b: b["block_index"]).alias("block_indices"),
            T.sorted_set(F.concat(r["medical"], r["illegal"])).alias("hit_keywords"),
            *[r[c].alias(c) for c in ("hit_rules", "phones", "wechat_ids", "qqs", "risk_score")],
            level(r["risk_score"], rules).alias("risk_level"),
            suspicious.alias("suspicious"),
        ).cast(AD)

    return F.when(signal, bound({"points": polygon}, ad))


def with_ads(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ads: regions with a signal, in order, without duplicates.

    Of an ad and the first earlier one that it repeats, the higher score stays, the earlier of equals; a better one is put
    at the end. ad_index is given before the weaker one goes, so numbers can repeat. Polygons end with the image where
    requests have image_width and image_height, null where not known.
    """
    numbered = lambda a, n: F.struct(n.alias("ad_index"), *[a[f].alias(f) for f in AD_FIELDS]).cast(AD)

    def add(kept: Column, new: Column) -> Column:
        again = F.transform(kept, lambda k: (G.iou(k, new) >= 0.45) | _same_boxes(k["block_indices"], new["block_indices"]))
        first = F.array_position(again, True).cast("int")
        # The place of the one to go: none for a new ad, and -1 to turn a weaker one down.
        gone = F.when(first == 0, 0).when(F.get(kept, first - 1)["risk_score"] < new["risk_score"], first).otherwise(-1)
        place = F.transform(F.array(gone), lambda g: F.when(g < 0, kept).otherwise(F.concat(F.filter(kept, lambda k, i: i != g - 1), F.array(numbered(new, F.size(kept) + 1)))))
        return F.get(place, F.lit(0))

    out = members(requests)
    width, height = (F.col(c) if c in requests.columns else None for c in ("image_width", "image_height"))
    polygon = lambda r: G.clipped_points(refined(r["ad_boxes"], r), width, height)
    out = out.withColumn("listed", F.array_compact(F.transform("regions", lambda r: ad_of(r, r["ad_boxes"], polygon(r), rules))))
    return out.withColumn("ads", F.aggregate("listed", F.array().cast(f"array<{AD}>"), add)).drop("listed")
