"""What the operators of this subpackage share: word rule, shared folder, written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words; a word is a longest run of any others.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a file of a small table.
ROWS_OF_FILE = 20_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(text: Column) -> Column:
    """The text with each parting character turned into a blank; replace() is several times as fast as translate()."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


#: Folders made for local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a session whose executors are threads of the driver may do without
    it: that one gets a temporary folder, any other an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="boxsift-")
        _LOCAL[context.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_name(columns: list[str], name: str = "_") -> str:
    """name with underscores before it until no column starts with it, in either case of letters."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df, written as Parquet into the shared folder and read again: cuts lineage, survives lost executors.

    rows is a bound on their number, if one is known: few rows then make few files.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(1 + rows // ROWS_OF_FILE)
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches that rows go to Python in; Spark's own bound of 64 MB fills a small executor beside its heap.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES, unless the session has a bound of its own; the bound stays with it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "64m") in ("64m", "67108864b", "67108864"):
        conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(f, schema)


def token_file(name: str, path: str | None = None) -> str:
    """Path of a public tokenizer file; an explicit path wins."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def most_frequent(counts: DataFrame, most: int, name: str) -> DataFrame:
    """The rows of counts (..., n) with the highest n, most of them at most: whole classes of about equal n, sixteen to a
    doubling, so that the cut needs a table of classes only and no rows are ranked or sent in excess."""
    counts = written(counts.withColumn("_class", F.floor(F.log2(F.col("n").cast("double")) * 16)), name)
    classes = counts.groupBy("_class").agg(F.count("*").alias("rows")).collect()  # some hundreds
    taken, least = 0, None
    for r in sorted(classes, key=lambda r: -r["_class"]):
        if taken + r["rows"] > most:
            break
        taken, least = taken + r["rows"], r["_class"]
    return counts.where(F.lit(False) if least is None else F.col("_class") >= least).drop("_class")
