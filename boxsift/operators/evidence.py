"""Evidence of each box: which words, contacts and noise it holds, and the rules that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.functions import text as T
from boxsift.rules import NOISE_OF_BOXES, RuleSet

HIT_COLUMNS = ("medical_hits", "illegal_hits", "contact_hits", "phones", "wechat_ids", "qqs", "noise_hits")


def hit_columns(text: Column, rules: RuleSet) -> dict[str, Column]:
    return {
        "medical_hits": T.word_hits(text, rules.medical_keywords, rules.medical_aliases),
        "illegal_hits": T.word_hits(text, rules.illegal_keywords, rules.illegal_aliases),
        "contact_hits": T.sorted_set(T.hits(text, rules.contact_keywords)),
        "phones": T.phones(text, rules.phone_pattern),
        "wechat_ids": T.matches(text, rules.wechat_pattern),
        "qqs": T.matches(text, rules.qq_pattern),
        "noise_hits": T.hits(text, (*rules.noise_keywords, *NOISE_OF_BOXES)),
    }


def evidence(boxes: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """boxes with seven arrays of hits; one projection, no shuffle."""
    return boxes.withColumns(hit_columns(F.col("text"), rules or RuleSet()))


def some(name: str) -> Column:
    return F.size(name) > 0


def has_keyword() -> Column:
    return some("medical_hits") | some("illegal_hits")


def has_contact() -> Column:
    return some("phones") | some("wechat_ids") | some("qqs")


def is_contact_like() -> Column:
    return has_contact() | some("contact_hits") | T.has_contact_digits(F.col("text"))


def annotations(found: DataFrame) -> DataFrame:
    """Rules and clue types of each box, and whether it matched at all."""
    named = {"medical.keyword": some("medical_hits"), "illegal.keyword": some("illegal_hits"), "contact.phone": some("phones"), "contact.wechat": some("wechat_ids"), "contact.qq": some("qqs")}
    clues = {"risk_word": has_keyword(), "phone": some("phones"), "wechat": some("wechat_ids"), "qq": some("qqs")}
    listed = lambda tests: F.array_sort(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))
    out = found.withColumns({"hit_rules": listed(named), "clue_types": listed(clues), "hit_keywords": T.sorted_set(F.concat("medical_hits", "illegal_hits"))})
    return out.withColumn("matched", F.size("hit_rules") > 0)


def documents(annotated: DataFrame) -> DataFrame:
    """Document-level contacts, keywords and rules of the boxes alone, and the joined text; one shuffle on the request."""
    united = lambda c: T.sorted_set(F.flatten(F.collect_set(c)))
    texts = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return annotated.groupBy("request_id").agg(
        *[united(c).alias(c) for c in ("phones", "wechat_ids", "qqs", "hit_keywords", "hit_rules")],
        F.array_join(F.transform(texts, lambda b: b["text"]), "\n").alias("ocr_text"),
        F.count("*").alias("n_blocks"),
    )
