"""Registered queries of the rule engine, each over its whole table, with the SQL that DuckDB runs beside them.

Arrays are joined to text in results, so that both engines give plain columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxsift import oracles
from boxsift.functions import geometry as G
from boxsift.functions import text as T
from boxsift.functions.rows import kept
from boxsift.operators import cards as K
from boxsift.operators import evidence as E
from boxsift.operators import focus as X
from boxsift.operators import planning as P
from boxsift.operators import readings as D
from boxsift.operators import regions as R
from boxsift.operators import selection as S
from boxsift.operators import views as V
from boxsift.plans import retry as Y
from boxsift.plans.evaluate import Evaluation, evaluate, evaluate_requests, evaluate_text
from boxsift.rules import RuleSet
from boxsift.sources import boxes as B
from boxsift.sources.files import sorted_out
from boxsift.sources.shared import shared_path
from boxsift.streaming import evaluate_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.SQL
RULES = RuleSet()
#: Tasks that the pairs of one group of part names go to.
PARTS = 4


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(a: Column | str) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_lineitem(spark, sf_dir)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence(boxes(spark, sf_dir), RULES)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, text) of documents and of conversation turns."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return docs.union(turns)


# Sources


@query
def text_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_text(table(spark, sf_dir, "documents"), "doc_id", "text").select("request_id", "block_index", "text", "x1", "y1", "confidence")


@query
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name of a fetched image: md5 of request and url, and the url's suffix."""
    pages = table(spark, sf_dir, "pages")
    rid = B.request_name(F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("page_id").cast("string")))
    suffix = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"/[^/]*?(\.[A-Za-z0-9]+)$", 1)
    name = F.concat(F.md5(F.concat_ws(":", rid, "url")), F.when(suffix == "", ".jpg").otherwise(suffix))
    return pages.select("page_id", rid.alias("request_id"), name.alias("file_name"))


# Evidence


@query
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return boxes(spark, sf_dir).select("request_id", "block_index", joined(T.hits(t, RULES.medical_keywords)).alias("medical"), joined(T.hits(t, RULES.illegal_keywords)).alias("illegal"))


@query
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return boxes(spark, sf_dir).select("request_id", "block_index", joined(T.alias_hits(t, RULES.medical_aliases)).alias("medical"), joined(T.alias_hits(t, RULES.illegal_aliases)).alias("illegal"))


@query
def noise_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir)
    return rows.select("request_id", "block_index", joined("noise_hits").alias("noise"), joined(P.noise_of_reading(F.col("text"), RULES)).alias("reading_noise"))


@query
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("request_id", "block_index", joined("phones").alias("phones"))


@query
def wechat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("request_id", "block_index", joined("wechat_ids").alias("wechat_ids"))


@query
def qq_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("request_id", "block_index", joined("qqs").alias("qqs"))


@query
def block_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.annotations(found(spark, sf_dir))
    return rows.select("request_id", "block_index", "matched", *[joined(c).alias(c) for c in ("hit_keywords", "hit_rules", "clue_types")])


@query
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = E.documents(E.annotations(found(spark, sf_dir)))
    return docs.select("request_id", "n_blocks", "ocr_text", *[joined(c).alias(c) for c in ("phones", "wechat_ids", "qqs", "hit_keywords", "hit_rules")])


# Text


@query
def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir).select("kind", "id", T.is_meaningful(t).alias("meaningful"), T.solid_length(t).cast("long").alias("solid_length"), T.has_phone_digits(t).alias("phone_digits"), T.has_partial_contact(t).alias("partial_contact"))


@query
def punctuation_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.from_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = lines.select("request_id", "block_index", F.posexplode(F.split("text", " ")).alias("word_index", "word"))
    return words.groupBy("request_id").agg(F.count("*").alias("words"), F.count_if(T.is_punctuation_noise(F.col("word"))).alias("noise_words"))


@query
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("request_id", "block_index", T.normalized(F.col("text")).alias("normalized"))


@query
def similar_text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar texts among the boxes of a request."""
    rows = boxes(spark, sf_dir).select("request_id", "block_index", T.normalized(F.col("text")).alias("t"))
    same = (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.block_index") < F.col("b.block_index"))
    pairs = rows.alias("a").join(rows.alias("b"), same)
    return pairs.where(T.is_similar(F.col("a.t"), F.col("b.t"))).select("a.request_id", F.col("a.block_index").alias("a_index"), F.col("b.block_index").alias("b_index"))


@query
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized documents and turns, by length and digest."""
    t = T.normalized(F.coalesce("text", F.lit("")))
    return texts(spark, sf_dir).select("kind", "id", F.length(t).alias("length"), F.md5(t.cast("binary")).alias("digest"))


@query
def turn_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversation turns that are marks only."""
    lines = B.from_text(table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text"), "id", "text")
    words = lines.select("request_id.conv_id", "request_id.turn", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.count_if(T.is_punctuation_noise(F.col("word"))).alias("noise_words"))


@query
def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names among the parts of one brand, type and size: each distinct name is met once, with the number of its parts."""
    name = T.normalized(F.concat_ws(" ", "p_name", F.lit("no"), (F.col("p_partkey") % 50).cast("string")))
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type", name.alias("t")).agg(F.count("*").alias("n"))
    rows = rows.select("*", T.coded(F.col("t")).alias("c")).select("p_brand", "p_type", "t", "n", "c.*")
    # The pairs of a group are dealt over several tasks; few bytes make many pairs, so the number of tasks is given.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda side: side.repartition(tasks, "p_brand", "p_type", "part")
    a = dealt(rows.withColumn("part", F.pmod(F.hash("t"), F.lit(PARTS)))).alias("a")
    b = dealt(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))).hint("shuffle_hash").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_type", "part")])
    fields = ("t", "length", *[f"w{k}" for k in range(T.WORDS)], "rest")
    of = lambda side: {c: F.col(f"{side}.{c}") for c in fields}
    pairs = a.join(b, same & (F.col("a.t") < F.col("b.t"))).where(T.is_similar_coded(of("a"), of("b")))
    return pairs.select("a.p_brand", "a.p_type", F.col("a.t").alias("a_name"), F.col("b.t").alias("b_name"), F.col("a.n").alias("a_parts"), F.col("b.n").alias("b_parts"))


@query
def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as base64, null where there is none: every tenth page counts as missing."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.encoded(F.when(F.col("page_id") % 10 != 0, F.col("html"))).cast("binary")).alias("encoded_md5"))


# Geometry


@query
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box_of_points(F.col("points"))
    x, y = G.center(b)
    wide = G.expanded(b, 10, 20)
    inside = G.clipped(b, F.lit(500), F.lit(600))
    return boxes(spark, sf_dir).select("request_id", "block_index", *[v.alias(k) for k, v in b.items()], x.alias("center_x"), y.alias("center_y"), wide["x1"].alias("wide_x1"), wide["y2"].alias("wide_y2"), *[v.alias(f"clip_{k}") for k, v in inside.items()], G.angle(F.col("points")).alias("angle"))


def turned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that stand along whole-number directions, one for each part."""
    k, s, t = F.col("p_partkey").cast("int"), (2 + F.col("p_partkey") % 7).cast("int"), (1 + F.col("p_partkey") % 5).cast("int")
    dx = F.get(F.array(*map(F.lit, (4, 12, 5, 3, 1, -4))), k % 6)
    dy = F.get(F.array(*map(F.lit, (3, 5, 12, -4, 0, 3))), k % 6)
    x, y = 100 + k % 300, 100 + k % 200
    corner = lambda a, b: F.array((x + a * dx * s - b * dy * t).cast("int"), (y + a * dy * s + b * dx * t).cast("int"))
    points = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", points.alias("points"))


@query
def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of turned rectangles, the box around them and their shape as a card."""
    rows = turned_points(spark, sf_dir)
    return rows.select("p_partkey", F.round(G.angle(F.col("points")), 6).alias("angle"), *[v.alias(c) for c, v in G.box_of_points(F.col("points")).items()], X.card_shape(F.col("points")).alias("shape"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("request_id", "block_index", "x1", "y1", "x2", "y2")
    return rows.alias("a").join(rows.alias("b"), (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.block_index") != F.col("b.block_index")))


@query
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.columns_of("a"), G.columns_of("b")
    rows = pairs(spark, sf_dir).where((F.col("a.block_index") < F.col("b.block_index")) & G.intersects(a, b))
    return rows.select("a.request_id", F.col("a.block_index").alias("a_index"), F.col("b.block_index").alias("b_index"), F.round(G.iou(a, b), 6).alias("iou"), G.centers_close(a, b).alias("close"), F.round(G.distance(a, b), 4).alias("distance"))


@query
def nearby_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which b's center lies in a, padded by 14 % of its sides and 12 pixels at least, or whose overlap is 0.08."""
    a, b = G.columns_of("a"), G.columns_of("b")
    pad = lambda lo, hi: F.greatest(F.lit(12), ((a[hi] - a[lo]) * 0.14).cast("int"))
    x, y = G.center(b)
    near = G.contains_point(G.expanded(a, pad("x1", "x2"), pad("y1", "y2")), x, y) | (G.iou(a, b) >= 0.08)
    return pairs(spark, sf_dir).where(near).select("a.request_id", F.col("a.block_index").alias("a_index"), F.col("b.block_index").alias("b_index"))


def cards(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Cards of every third request: its first box grown to a card, and its third box as it is."""
    rows = (boxes(spark, sf_dir) if rows is None else rows).where("request_id % 3 = 0 AND block_index IN (0, 2)")
    grown = lambda c, by: (F.col(c) + F.when(F.col("block_index") == 0, by).otherwise(0)).alias(c)
    return rows.select("request_id", F.floor(F.col("block_index") / 2).cast("int").alias("card"), grown("x1", -40), grown("y1", -60), grown("x2", 40), grown("y2", 60))


@query
def card_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each card: range join within the request."""
    rows = boxes(spark, sf_dir).select("request_id", "block_index", "x1", "y1", "x2", "y2")
    met = (F.col("c.request_id") == F.col("b.request_id")) & K.on_card(G.columns_of("c"), G.columns_of("b"))
    return cards(spark, sf_dir).alias("c").join(rows.alias("b"), met).select("b.request_id", "c.card", "b.block_index")


@query
def card_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards among the boxes of a request, as if these were outlines found in an image of 900 x 1000."""
    c = F.col
    found = boxes(spark, sf_dir).select("request_id", c("block_index").alias("ordinal"), c("x1").alias("x"), c("y1").alias("y"), (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"), ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("area"), F.lit(900).alias("width"), F.lit(1000).alias("height"))
    return K.card_candidates(found)


# Joins within a request


@query
def core_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword boxes, and boxes within 90 pixels of one that are neither noise nor a contact; within the request's row."""
    rows = R.nested(found(spark, sf_dir)).withColumn("words", F.filter("blocks", lambda b: b["keyword"]))
    beside = lambda b: ~b["noise"] & ~b["contact"] & F.exists("words", lambda w: G.distance(b, w) <= R.CORE_DISTANCE)
    rows = rows.select("request_id", F.explode(F.filter("blocks", lambda b: b["keyword"] | beside(b))).alias("b"))
    return rows.select("request_id", "b.block_index", "b.keyword")


def evaluated(spark: SparkSession, sf_dir: str) -> Evaluation:
    return evaluate(boxes(spark, sf_dir), RULES)


@query
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.text_regions(R.nested(found(spark, sf_dir)), RULES)
    rows = rows.select("request_id", F.posexplode("regions").alias("region", "r"))
    return rows.select("request_id", "region", "r.anchor", joined("r.members").alias("members"), "r.x1", "r.y1", "r.x2", "r.y2")


@query
def contact_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).regions.select("request_id", "region", F.explode("attachments").alias("a"))
    return rows.select("request_id", "region", "a.block_index", "a.score", (F.col("a.score") >= R.ATTACHED).alias("accepted"))


@query
def region_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).regions
    return rows.select("request_id", "region", "combined", "risk_score", *[joined(c).alias(c) for c in ("medical", "illegal", "phones", "wechat_ids", "qqs", "hit_rules")])


@query
def ad_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = evaluated(spark, sf_dir).ads
    return ads.select("request_id", "position", "ad_index", "risk_score", "risk_level", "suspicious", "x1", "y1", "x2", "y2", joined("block_indices").alias("block_indices"), joined("hit_rules").alias("hit_rules"))


def _told(documents: DataFrame, *more: str) -> DataFrame:
    lists = ("phones", "wechat_ids", "qqs", "hit_keywords", "hit_rules")
    return documents.select("request_id", "n_blocks", F.size("ads").alias("n_ads"), "risk_score", "risk_level", "suspicious", "empty_reason", *[joined(c).alias(c) for c in lists], *more)


@query
def spatial_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(evaluated(spark, sf_dir).documents)


@query
def empty_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).documents.groupBy("empty_reason").agg(F.count("*").alias("requests"))


@query
def text_only_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come as text: the generated boxes' texts joined by line breaks, and evaluated line by line."""
    joined_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n")
    requests = boxes(spark, sf_dir).groupBy("request_id").agg(joined_text.alias("ocr_text"))
    return _told(evaluate_text(requests, "request_id", "ocr_text", RULES))


@query
def card_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their cards, whose boxes form regions ahead of those of the text."""
    return _told(evaluate(boxes(spark, sf_dir), RULES, cards(spark, sf_dir)).documents)


@query
def diagnostic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line for each request: what it says as a whole, and its first twenty boxes."""
    rows = evaluated(spark, sf_dir).nested
    matched = lambda b: F.greatest(*[F.size(b[c]) for c in ("medical_hits", "illegal_hits", "phones", "wechat_ids", "qqs")]) > 0
    first = F.transform(F.slice("blocks", 1, 20), lambda b: F.struct(b["text"].alias("text"), matched(b).alias("matched")))
    return rows.select("request_id", F.to_json(F.struct("risk_score", "suspicious", "hit_keywords", "hit_rules", first.alias("ocr_blocks"))).alias("report"))


@query
def best_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a request's boxes, as if each were a second look at the image."""
    c = F.col
    looks = boxes(spark, sf_dir).select("request_id", c("block_index").alias("ordinal"), (c("x1") % 7).alias("semantic_score"), c("confidence"), (c("y1") % 3).alias("boxes"))
    return D.best_retry(looks)


@query
def recognised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a recogniser's parallel arrays, gathered from the generated boxes with half a pixel added."""
    of = lambda f: F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text", "points", "confidence"))), f)
    shifted = lambda b: F.transform(b["points"], lambda p: F.transform(p, lambda v: v + 0.25))
    rows = boxes(spark, sf_dir).groupBy("request_id").agg(of(shifted).alias("p"), of(lambda b: F.concat(F.lit(" "), b["text"])).alias("t"), of(lambda b: b["confidence"]).alias("s"))
    return D.from_results(rows, "request_id", "p", "t", "s").drop("points")


@query
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of results nested in pages: the first box, a null one and the others on a second page, after an empty and a null page."""
    item = F.struct(F.transform("points", lambda p: F.transform(p, lambda v: v.cast("double") + 0.25)).alias("points"), F.struct(F.concat("text", F.lit(" ")).alias("text"), F.col("confidence").alias("score")).alias("rec"))
    rows = boxes(spark, sf_dir).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("block_index", item.alias("i")))).alias("b"))
    items = F.transform("b", lambda b: b["i"])
    none = F.slice(items, 1, 0)
    pages = F.array(F.slice(items, 1, 1), none, F.lit(None), F.concat(F.array(F.lit(None)), F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))))
    return D.from_pages(rows.select("request_id", pages.alias("pages")), "request_id", "pages").drop("points")


@query
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON request for each box, every other one with the box and the rest with its text; a fourth has no id, a fourth an
    empty one, and a fourth all the same: each is judged alone."""
    rows = boxes(spark, sf_dir).withColumn("request_key", (F.col("request_id") * 100 + F.col("block_index")).cast("string"))
    shown = F.when(F.col("block_index") % 4 == 1, "").when(F.col("block_index") % 4 == 2, "same").when(F.col("block_index") % 4 == 3, F.col("request_key"))
    box = F.when(F.col("request_id") % 2 == 0, F.array(F.struct("text", "points", "confidence")))
    rows = rows.select("request_key", F.to_json(F.struct(shown.alias("request_id"), F.when(box.isNull(), F.col("text")).alias("ocr_text"), box.alias("ocr_blocks"))).alias("line"))
    told = evaluate_requests(B.parse_requests(rows, "line"), RULES).withColumnRenamed("request_id", "shown_id").withColumnRenamed("request_key", "request_id")
    return _told(told, "shown_id")


@query
def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines, of which four in seven are spoilt in as many ways, read back and sorted out: lines, boxes
    and texts by the reason for which they are turned away."""
    every = F.array_sort(F.collect_list(F.struct("block_index", "text", "points", "confidence")))
    rows = boxes(spark, sf_dir).groupBy("request_id").agg(every.alias("b")).withColumn("k", (F.col("request_id") % 7).cast("int"))
    text, points = F.when(F.col("k") != 2, F.col("b.text")[0]), F.when(F.col("k") == 3, F.array(F.array(F.lit(1), F.lit(2), F.lit(3)))).otherwise(F.col("b.points")[0])
    first = F.struct(text.alias("text"), points.alias("points"), F.col("b.confidence")[0].alias("confidence"))
    rest = F.transform(F.slice("b", 2, F.greatest(F.size("b"), F.lit(1))), lambda x: F.struct(x["text"], x["points"], x["confidence"]))
    listed = F.when(F.col("k") == 1, F.array().cast("array<struct<text:string,points:array<array<int>>,confidence:double>>")).otherwise(F.concat(F.array(first), rest))
    line = F.to_json(F.struct(F.col("request_id").cast("string").alias("request_id"), listed.alias("ocr_blocks")), {"ignoreNullFields": "false"})
    path = shared_path(spark, "requests")
    rows.select(F.when(F.col("k") == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    found = sorted_out(spark, path).groupBy(F.coalesce("rejected", F.lit("")).alias("rejected"))
    return found.agg(F.count("*").alias("lines"), F.sum(F.greatest(F.coalesce(F.size("ocr_blocks"), F.lit(0)), F.lit(0))).alias("boxes"), F.count("request_id").alias("with_id"))


@query
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come as text in JSON files, evaluated by a stream that ends with the last file, as it wrote them."""
    joined_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n")
    path = shared_path(spark, "stream")
    boxes(spark, sf_dir).groupBy(F.col("request_id").cast("string").alias("request_id")).agg(joined_text.alias("ocr_text")).write.json(f"{path}/in")
    evaluate_stream(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", RULES).awaitTermination()
    return _told(spark.read.parquet(f"{path}/out"))


@query
def background_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of regions where the colours behind four boxes in five are known, with the reason why one does not attach."""
    part, supp, line = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "linenumber"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.row_number().over(order) - 1).cast("int").alias("block_index"), F.array(part * 13 % 256, supp * 7 % 256, (part * 3 + line) % 256).alias("mean"), F.array(part % 60, supp % 50, line * 9 % 40).alias("spread"))
    told = evaluate(boxes(spark, sf_dir), RULES, signatures=rows.where("block_index % 5 <> 4")).regions.select("request_id", "region", F.explode("attachments").alias("a"))
    return told.select("request_id", "region", "a.block_index", "a.score", "a.background", "a.reason")


@query
def draw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of suspicious requests: boxes that matched or belong to an ad, red for risk words, else yellow."""
    rows = evaluated(spark, sf_dir).nested.withColumn("inside", F.flatten(F.transform("ads", lambda a: a["block_indices"])))
    drawn = F.filter("blocks", lambda b: b["keyword"] | b["contact"] | F.array_contains("inside", b["block_index"]))
    drawn = F.transform(drawn, lambda b: F.struct(b["block_index"], F.when(b["keyword"], "red").otherwise("yellow").alias("colour"), *[b[c] for c in ("x1", "y1", "x2", "y2")]))
    rows = kept(rows.select("request_id", "suspicious", drawn.alias("drawn")), F.col("suspicious") & F.col("request_id").isNotNull())
    return rows.select("request_id", F.inline_outer("drawn")).where("block_index IS NOT NULL")


def polygon(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ",")


@query
def ad_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the ads of suspicious requests, with their labels and where these go (text of 24 pixels' height)."""
    rows = kept(evaluated(spark, sf_dir).documents, F.col("suspicious")).select("request_id", F.posexplode_outer("ads").alias("position", "a"))
    return rows.select("request_id", "position", polygon(F.col("a.points")).alias("points"), *[v.alias(k) for k, v in X.label(F.col("a"), 24).items()])


@query
def refined_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest rectangle around all turned boxes of an image, grown as an ad's region is, and cut at an image of 400 x 300."""
    k = F.col("p_partkey").cast("int")
    rows = turned_points(spark, sf_dir).select(F.floor(k / 5).alias("request_id"), (k % 5).alias("block_index"), F.lit("x").alias("text"), "points", F.lit(1.0).alias("confidence"))
    rows = R.nested(E.evidence(rows.withColumns(G.box_of_points(F.col("points"))), RULES))
    rows = rows.select("request_id", G.smallest_rectangle(R.corner_cloud(F.col("blocks"))).alias("r"), R.refined(F.col("blocks"), R.bounds(F.col("blocks"))).alias("points"))
    sides = [F.round(f"r.{c}", 6).alias(c) for c in ("angle", "width", "height")]
    return rows.select("request_id", *sides, polygon(F.col("points")).alias("points"), polygon(G.clipped_points(F.col("points"), F.lit(400), F.lit(300))).alias("clipped"), X.rectangle_shape(F.col("r")).alias("shape"))


# Readings


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.readings(boxes(spark, sf_dir))
    return rows.select("request_id", joined(F.transform(D.reading_order(F.col("readings")), lambda b: b["block_index"])).alias("ordered"), D.average_confidence(F.transform("readings", lambda b: b["confidence"])).alias("confidence"))


@query
def ocr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.readings(boxes(spark, sf_dir))
    return rows.select("request_id", joined(F.transform(D.without_duplicates(F.col("readings")), lambda b: b["block_index"])).alias("kept"))


@query
def round_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even index are the first round, the others a closer look."""
    rows = D.readings(boxes(spark, sf_dir))
    half = lambda k: F.filter("readings", lambda b: b["block_index"] % 2 == k)
    first, focus = half(0), half(1)
    return rows.select("request_id", joined(F.transform(D.merge_rounds(first, focus), lambda b: b["block_index"])).alias("kept"))


@query
def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.clusters(D.readings(boxes(spark, sf_dir)))
    return rows.select("request_id", F.posexplode("clusters").alias("cluster", "members")).select("request_id", "cluster", joined("members").alias("members"))


# Planning


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first round says of a request; every third one has a card."""
    return P.round_features(evaluated(spark, sf_dir).nested, F.col("request_id") % 3 == 0, RULES)


@query
def oblique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned scraps of text below the main text: five parts make up an image, each a box along a whole-number direction."""
    k = F.col("p_partkey").cast("int")
    text = F.get(F.array(*map(F.lit, ("8", "甲 乙", "no 12345", "--", "保"))), (k * 7 % 5).cast("int"))
    rows = turned_points(spark, sf_dir).select(F.floor(k / 5).alias("request_id"), (k % 5).alias("block_index"), text.alias("text"), "points", F.lit(1.0).alias("confidence"))
    rows = R.nested(E.evidence(rows.withColumns(G.box_of_points(F.col("points"))), RULES))
    return rows.select("request_id", joined(P.oblique_indices()).alias("oblique"))


@query
def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("request_id", P.semantic_score(RULES).alias("semantic_score"), "solid_length", "low_confidence")


@query
def semantic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = P.entities(RULES)
    return features(spark, sf_dir).select("request_id", joined(told["noise_hits"]).alias("noise_hits"), told["odd_blocks"].alias("odd_blocks"), told["block_count"].alias("block_count"))


@query
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("request_id", P.retry_reason(P.RetrySettings()).alias("reason"))


@query
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants to try over the frame of all boxes, as a rectangle taken from the card where there is one."""
    b = R.bounds(F.col("blocks"))
    rows = features(spark, sf_dir).withColumns({"width": b["x2"] - b["x1"], "height": b["y2"] - b["y1"], "shape": F.when(F.col("request_id") % 2 == 0, "trapezoid").otherwise("rectangle"), "angle": F.lit(0.0), "source": F.when(F.col("has_card"), "card_candidate").otherwise("cluster")})
    return rows.select("request_id", joined(P.retry_variants(P.RetrySettings())).alias("variants"))


@query
def ocr_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of an image for each part: sides from the part's numbers."""
    w, h = (300 + (F.col("p_partkey") * 37) % 2200).cast("int"), (300 + (F.col("p_partkey") * 53) % 2400).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))
    kinds = {"initial": P.initial_views, "tile": P.tile_views, "scan": P.scan_views}
    out = None
    for kind, make in kinds.items():
        one = rows.select("p_partkey", F.lit(kind).alias("kind"), F.inline(make(F.col("w"), F.col("h"))))
        out = one if out is None else out.union(one)
    return out


@query
def annotation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines, labels and the kept size of an image for each part."""
    w, h = (300 + (F.col("p_partkey") * 37) % 2200).cast("int"), (300 + (F.col("p_partkey") * 53) % 2400).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in X.drawing(w, h).items()])


@query
def view_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    side = (600 + F.col("request_id") % 1500).cast("int")
    confidence = D.average_confidence(F.transform("blocks", lambda b: b["confidence"]))
    return rows.select("request_id", P.scan_due(side).alias("scan"), P.rotation_due(side, RULES).alias("rotation"), P.tiles_due(side, confidence).alias("tiles"))


@query
def focus_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames for a closer look at a box in an image of 900 x 1000: as a card, as a wide card, as a small box, turned."""
    b, w, h = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.lit(900), F.lit(1000)
    kinds = {"card": X.card_frame(b, w, h), "wide": X.card_frame(b, w, h, wide=True), "box": X.box_frame(b, w, h), "turned": X.variant_frame(b, "rotate_180", w, h), "side": X.variant_frame(b, "rotate_90", w, h)}
    rows = [F.struct(F.lit(k).alias("kind"), *[v.alias(c) for c, v in f.items()]) for k, f in kinds.items()]
    return boxes(spark, sf_dir).select("request_id", "block_index", F.inline(F.array(*rows)))


def card_outlines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Cards with their four corners: the first of a request a rectangle, the second narrower at the top."""
    at = lambda x, y: F.array(x.cast("int"), F.col(y).cast("int"))
    inset = F.when(F.col("card") == 1, F.floor((F.col("x2") - F.col("x1")) / 4)).otherwise(0)
    points = F.array(at(F.col("x1") + inset, "y1"), at(F.col("x2") - inset, "y1"), at(F.col("x2"), "y2"), at(F.col("x1"), "y2"))
    return cards(spark, sf_dir, rows).withColumn("points", points)


def tilted(blocks: Column) -> Column:
    """Every third box as if its text were turned by 30 degrees."""
    return F.transform(blocks, lambda b: b.withField("angle", F.when(b["block_index"] % 3 == 2, 30.0).otherwise(0.0)))


def focused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the frame for a closer look, in an image of 900 x 1000; every third box counts as turned by 30 degrees."""
    rows = evaluated(spark, sf_dir).nested.withColumn("blocks", tilted(F.col("blocks")))
    rows = S.with_card_lists(rows, card_outlines(spark, sf_dir)).withColumns({"image_width": F.lit(900), "image_height": F.lit(1000)})
    return S.with_focus(P.round_features(rows, F.size("cards") > 0, RULES), RULES)


@query
def focus_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frame of each request among clusters, cards and oblique scraps of text."""
    rows = kept(focused(spark, sf_dir), F.col("focus").isNotNull())
    return rows.select("request_id", *[f"focus.{c}" for c in ("source", "place", "score", "x1", "y1", "x2", "y2", "shape")], F.round("focus.angle", 6).alias("angle"), F.col("focus.card.card").alias("card"), joined("focus.members").alias("members"))


@query
def view_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned views of an image for each part and the straightened view of a card in it, with their maps back (off ties by a
    constant) and where a point of the view lies in the image."""
    k = F.col("p_partkey").cast("int")
    points = F.transform("points", lambda p, i: F.array(p[0] + F.when(i == 2, k % 11).otherwise(0), p[1] + F.when(i == 1, k % 7).otherwise(0)))
    rows = turned_points(spark, sf_dir).select("p_partkey", (300 + k % 500).alias("w"), (200 + k % 700).alias("h"), F.array(F.struct(points.alias("points"))).alias("cards"))
    rows = rows.select("p_partkey", F.explode(F.concat(V.rotation_views(F.col("w"), F.col("h")), V.card_views(F.col("cards")))).alias("v"))
    probe = F.array(F.array(F.lit(18), F.lit(27)))
    matrix = F.array_join(F.transform(F.flatten("v.matrix"), lambda x: F.format_string("%.4f", x + 1.2345678e-5)), " ")
    back = F.get(X.mapped_back(probe, F.col("v")), F.lit(0))
    return rows.select("p_partkey", *[f"v.{c}" for c in ("name", "scale", "quadrants", "crop_width", "crop_height")], F.coalesce(matrix, F.lit("")).alias("matrix"), F.when(F.col("v.matrix").isNull(), back[0]).alias("x"), F.when(F.col("v.matrix").isNull(), back[1]).alias("y"))


@query
def retry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second looks in images of 900 x 1000. The first reading has the boxes of even number only; a view shows the others and
    every fourth again, more surely, but for a third of them that differs by view, in the view's own coordinates."""
    every = boxes(spark, sf_dir)
    first = every.where("block_index % 2 = 0").withColumn("block_index", F.floor(F.col("block_index") / 2).cast("int"))
    images = every.select("request_id").distinct().withColumns({"image_width": F.lit(900), "image_height": F.lit(1000)})
    features = Y.analysed(first, card_outlines(spark, sf_dir, first), images, RULES)
    tilt = tilted(F.col("blocks"))
    plan = Y.planned(P.round_features(features.select(*Y.TOLD).withColumn("blocks", tilt), F.size("cards") > 0, RULES), RULES, P.RetrySettings())
    hidden = every.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "text", "points", "confidence"))).alias("hidden"))
    shown = lambda b, k: ((b["block_index"] % 2 == 1) | (b["block_index"] % 4 == 0)) & ((b["block_index"] + k) % 3 != 0)
    sure = lambda b: F.when(b["block_index"] % 4 == 0, b["confidence"] + 1.0).otherwise(b["confidence"])
    look = lambda v, b: F.struct(v["variant"].alias("variant"), b["block_index"].alias("block_index"), b["text"].alias("text"), V.mapped_into(b["points"], v["view"]).alias("points"), sure(b).alias("confidence")).cast(Y.LOOK)
    looks = F.flatten(F.transform("views", lambda v, k: F.transform(F.filter("hidden", lambda b: shown(b, k)), lambda b: look(v, b))))
    out = Y.retried(plan.join(hidden, "request_id").withColumn("looks", looks), RULES)
    texts = F.array_join(F.transform("final", lambda r: r["text"]), "|")
    return out.select("request_id", "reason", "first_score", "variant", "retry_score", "selected", "added", "confidence", texts.alias("ocr_text"))
