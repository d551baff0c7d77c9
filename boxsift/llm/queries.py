"""Registered queries of the numbered operators, each over its whole table, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxsift.llm import chat_format, decontamination, fill_middle, language_id, mixing, ngram_join, quality_classifier, quality_rules, secrets, token_align, token_output, url_filter, warc
from boxsift.llm.common import shared_dir, table, token_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_BOUND = {r.name: r for r in quality_rules.RULES}
ORACLE_SQL["op5_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win),
cover AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n >= 2) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS stops,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS letterless,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, len(ls) AS n_lines
      FROM w LEFT JOIN cover USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {_BOUND["word_length"].low} AND {_BOUND["word_length"].high}
       AND n_symbols / n_words <= {_BOUND["symbols"].high} AND stops / n_words >= {_BOUND["stop_words"].low}
       AND n_dup_lines / n_lines <= {_BOUND["repeated_lines"].high} AND n_lines / n_words <= {_BOUND["short_lines"].high}
       AND letterless / n_words <= {_BOUND["letterless_words"].high}
       AND (letters = 0 OR capitals / letters <= {_BOUND["capitals"].high}) AS kept
FROM r
"""


@query
def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", F.round("expected", 9).alias("expected"))


ORACLE_SQL["op2_pareto_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
b AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS m, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS nth FROM d),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight,
             3 * source_size AS cap FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS k FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT (SELECT arg_min(level, k) FROM l WHERE cap > weight * level) AS level),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * l.level THEN CAST(cap AS DOUBLE) ELSE weight * f.level END AS target FROM l, f),
c AS (SELECT source, m, sum(size) AS words FROM b GROUP BY source, m),
e AS (SELECT c.*, source_size, target, (target - CAST(coalesce(sum(3 * words) OVER (PARTITION BY c.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / nullif(CAST(sum(m * words) OVER (PARTITION BY c.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS level
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, arg_max(level, m) FILTER (m * level < 3) OVER (PARTITION BY source) AS final FROM e),
h AS (SELECT *, CASE WHEN m = 0 OR words = 0 THEN 0 WHEN m * level >= 3 THEN 3 ELSE m * final END AS expected FROM g),
i AS (SELECT *, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS chance,
             target - CAST(sum(floor(expected) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM h),
u AS (SELECT b.doc_id, b.source, size, digest, nth, source_size, target, expected, certain, chance, rest, greatest(least(chance, 1.0::DOUBLE - 1e-9::DOUBLE), 1e-9::DOUBLE) AS p,
             (CAST(CAST('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || nth)[1:12] AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM b JOIN i ON b.source IS NOT DISTINCT FROM i.source AND b.m = i.m),
q AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, digest, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(size) OVER (PARTITION BY source, rank IS NULL) AS everything FROM q),
x AS (SELECT *, rank IS NOT NULL AND rest > 0 AND (everything <= rest OR 2 * before + size <= 2 * rest) AS drawn FROM run)
SELECT doc_id, size, source_size, target, CAST((certain + CAST(drawn AS BIGINT)) * size AS BIGINT) AS taken, source, certain + CAST(drawn AS BIGINT) AS copies,
       round(expected, 9) AS expected
FROM x
"""


@query
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, token_file("word_bpe_49k.json"), end_id=2, by_word=True)
    return token_output.checksums(token_output.read_tokens(spark, path))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.without_payload(warc.read_records(index, folder, with_payload=False))


ORACLE_SQL["op10_warc"] = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, count(*) OVER (PARTITION BY payload_digest) AS n FROM p),
r AS (SELECT *, payload_bytes >= 100 AND n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), token_file("byte_bpe_50k.tiktoken")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(pages.select("url", "html"))
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "words", F.round("bad_score", 6).alias("bad_score"))


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can say: host, path, rule and the rule's verdict."""
    host, path = url_filter.split_url(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = url_filter.rule_hit(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("rule_verdict"))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
ORACLE_SQL["url_rules"] = rf"""
WITH r(h, p, v) AS (VALUES {_RULES}),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, rid, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT s.*, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, v AS rule_verdict FROM f WHERE k = 1
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out"))
    return language_id.predict(rows, model, keep=("doc_id", "held_out"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLE_SQL["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, rid, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM d),
e AS MATERIALIZED (SELECT rid, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN s x ON x.rid = p.x JOIN s y ON y.rid = p.y WHERE 100 * k >= 85 * (len(x.shingles) + len(y.shingles) - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s WHERE len(shingles) > 0 UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, CASE WHEN len(shingles) > 0 THEN coalesce(c.component_id, doc_id) ELSE doc_id END AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id
"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.digest(fill_middle.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS p, coalesce(array_to_string(us[a + 1:b], ''), '') AS m, coalesce(array_to_string(us[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(turns.unionByName(own))


@query
def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model"))
