"""Sources of text boxes: JSON requests, plain text, and a generator over lineitem for tests and benchmarks.

All give (request_id, block_index, text, points, x1, y1, x2, y2, confidence); block_index is dense from 0 and carries
the order, which anchors and ties depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxsift.functions.geometry import box_of_points
from boxsift.functions.text import LINE_BREAK, strip

REQUEST = "request_id STRING, ocr_text STRING, ocr_blocks ARRAY<STRUCT<text: STRING, points: ARRAY<ARRAY<INT>>, confidence: DOUBLE>>, _corrupt_record STRING"
DEFAULT_ID = "rule-evaluate"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of rule requests; a line that does not parse keeps its text in _corrupt_record."""
    return spark.read.schema(REQUEST).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_requests(rows: DataFrame, column: str) -> DataFrame:
    """rows with the fields of the JSON request in column; a text that does not parse is kept in _corrupt_record."""
    names = [c for c in rows.columns if c != column]
    parsed = F.from_json(column, REQUEST, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.select(*names, parsed.alias("_parsed")).select(*names, "_parsed.*")


def valid(requests: DataFrame) -> DataFrame:
    """Requests with text or boxes."""
    return requests.where("coalesce(ocr_text, '') <> '' OR size(ocr_blocks) > 0")


def request_name(given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.lit(DEFAULT_ID))


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: strip(x) != "")


def corners(b) -> Column:
    point = lambda x, y: F.array(b[x].cast("int"), b[y].cast("int"))
    return F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))


def from_text(rows: DataFrame, request_id: str, text: str) -> DataFrame:
    """A box at the origin for each line of text that is not blank."""
    boxes = rows.select(F.col(request_id).alias("request_id"), F.posexplode(lines(F.col(text))).alias("block_index", "text"))
    return boxes.withColumns({c: F.lit(0) for c in ("x1", "y1", "x2", "y2")} | {"confidence": F.lit(0.0)}).withColumn("points", F.array_repeat(F.array(F.lit(0), F.lit(0)), 4))


def keyed(requests: DataFrame, path: str) -> DataFrame:
    """The requests with a unique request_key, written as Parquet to path and read again, so that the keys never change."""
    rows = requests.withColumn("request_key", F.expr("uuid()"))
    rows.write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.schema(rows.schema).parquet(path)


def own_boxes(requests: DataFrame, request_id: Column) -> DataFrame:
    """The boxes that requests come with."""
    own = requests.select(request_id.alias("request_id"), F.posexplode("ocr_blocks").alias("block_index", "b"))
    return own.select("request_id", "block_index", "b.text", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), "b.points").withColumns(box_of_points(F.col("points")))


def from_requests(requests: DataFrame) -> DataFrame:
    """Boxes of requests as read_requests gives them; the text's lines only where there are no boxes.

    request_id is the request_key of keyed requests. Without keys it is the shown id, so that requests of equal ids, or
    more than one without an id, must be keyed first.
    """
    name = F.col("request_key") if "request_key" in requests.columns else request_name(F.col("request_id"))
    rows = valid(requests).withColumn("request_id", name)
    own = own_boxes(rows.where("size(ocr_blocks) > 0"), F.col("request_id"))
    return own.unionByName(from_text(rows.where("coalesce(size(ocr_blocks), 0) < 1"), "request_id", "ocr_text"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated boxes: a request for each order, integers only, so that other engines make the same rows."""
    part, supp, line = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "linenumber"))
    kind = (part % 12).cast("int")
    texts = {
        0: F.lit("医保卡高价回收"),
        1: F.concat(F.lit("微信 wx"), (100000 + supp).cast("string")),
        2: F.concat(F.lit("电话1"), (3000000000 + part * 7919).cast("string")),
        3: F.lit("收药"),
        4: F.lit("搬家 开锁"),
        5: F.concat(F.lit("QQ:"), (10000 + part).cast("string")),
        6: F.lit("取"),
        7: F.lit("现"),
        8: F.lit("保取现"),
        9: F.concat(F.lit("no "), part.cast("string")),
        10: F.lit("医"),
    }
    text = F.lit("保")
    for k, v in texts.items():
        text = F.when(kind == k, v).otherwise(text)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select(
        F.col("l_orderkey").alias("request_id"),
        (F.row_number().over(order) - 1).cast("int").alias("block_index"),
        text.alias("text"),
        ((part * 37) % 600).cast("int").alias("x1"),
        ((supp * 53 + line * 29) % 800).cast("int").alias("y1"),
        (40 + (part * 11) % 160).cast("int").alias("w"),
        (16 + (supp * 7) % 40).cast("int").alias("h"),
        ((50 + part % 50).cast("double") / 100).alias("confidence"),
    )
    rows = rows.select("request_id", "block_index", "text", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "confidence")
    return rows.withColumn("points", corners({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}))
