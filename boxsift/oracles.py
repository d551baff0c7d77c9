"""DuckDB SQL beside the registered queries, written for that engine: its regular expressions have no look-around, so
phones are found with their neighbours, of which the generated boxes have one at most."""

from __future__ import annotations

from boxsift.rules import ILLEGAL, ILLEGAL_ALIASES, MEDICAL, MEDICAL_ALIASES, CONTACT, NOISE, NOISE_OF_BOXES, NOISE_OF_READINGS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(words) -> str:
    return f"list_filter({_list(words)}, lambda w: contains(text, w))"


def _aliases(aliases) -> str:
    found = [f"CASE WHEN {' OR '.join(f"contains(text, '{w}')" for w in (k, *v))} THEN '{k}' END" for k, v in aliases.items()]
    return f"list_filter([{', '.join(found)}], lambda w: w IS NOT NULL)"


def _set(a: str) -> str:
    return f"list_sort(list_distinct({a}))"


def _joined(a: str) -> str:
    return f"coalesce(array_to_string({a}, ','), '')"


BOXES = """
box AS (SELECT l_orderkey AS request_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS block_index,
  CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN '医保卡高价回收' WHEN 1 THEN concat('微信 wx', CAST(100000 + l_suppkey AS VARCHAR))
    WHEN 2 THEN concat('电话1', CAST(3000000000 + l_partkey * 7919 AS VARCHAR)) WHEN 3 THEN '收药' WHEN 4 THEN '搬家 开锁'
    WHEN 5 THEN concat('QQ:', CAST(10000 + l_partkey AS VARCHAR)) WHEN 6 THEN '取' WHEN 7 THEN '现' WHEN 8 THEN '保取现'
    WHEN 9 THEN concat('no ', CAST(l_partkey AS VARCHAR)) WHEN 10 THEN '医' ELSE '保' END AS text,
  CAST((l_partkey * 37) % 600 AS INT) AS x1, CAST((l_suppkey * 53 + l_linenumber * 29) % 800 AS INT) AS y1,
  CAST((l_partkey * 37) % 600 + 40 + (l_partkey * 11) % 160 AS INT) AS x2,
  CAST((l_suppkey * 53 + l_linenumber * 29) % 800 + 16 + (l_suppkey * 7) % 40 AS INT) AS y2,
  CAST(50 + l_partkey % 50 AS DOUBLE) / 100 AS confidence FROM lineitem)"""

PHONE = r"(?:^|[^0-9])(1[3-9][0-9\-\s]{9,15})(?:[^0-9]|$)"
EVIDENCE = rf"""{BOXES},
ev AS (SELECT *, {_set(f"list_concat({_hits(MEDICAL)}, {_aliases(MEDICAL_ALIASES)})")} AS medical,
  {_set(f"list_concat({_hits(ILLEGAL)}, {_aliases(ILLEGAL_ALIASES)})")} AS illegal, {_set(_hits(CONTACT))} AS contact_hits,
  {_set(f"list_filter(list_transform(regexp_extract_all(text, '{PHONE}', 1), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) = 11 AND starts_with(d, '1'))")} AS phones,
  {_set(r"regexp_extract_all(text, '(?i)(?:微信|vx|wechat)[:：\s]*([a-zA-Z][-_a-zA-Z0-9]{5,19})', 1)")} AS wechat_ids,
  {_set(r"regexp_extract_all(text, '(?i)qq[:：\s]*([1-9][0-9]{4,11})', 1)")} AS qqs,
  {_hits((*NOISE, *NOISE_OF_BOXES))} AS noise FROM box),
an AS (SELECT *, {_set("list_concat(medical, illegal)")} AS hit_keywords,
  list_filter([CASE WHEN len(phones) > 0 THEN 'contact.phone' END, CASE WHEN len(qqs) > 0 THEN 'contact.qq' END, CASE WHEN len(wechat_ids) > 0 THEN 'contact.wechat' END,
    CASE WHEN len(illegal) > 0 THEN 'illegal.keyword' END, CASE WHEN len(medical) > 0 THEN 'medical.keyword' END], lambda r: r IS NOT NULL) AS hit_rules,
  list_filter([CASE WHEN len(phones) > 0 THEN 'phone' END, CASE WHEN len(qqs) > 0 THEN 'qq' END, CASE WHEN len(medical) + len(illegal) > 0 THEN 'risk_word' END,
    CASE WHEN len(wechat_ids) > 0 THEN 'wechat' END], lambda r: r IS NOT NULL) AS clue_types,
  len(medical) + len(illegal) > 0 AS keyword, len(phones) + len(wechat_ids) + len(qqs) > 0 AS contact FROM ev)"""

TEXTS = """t AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'turn', concat(conv_id, ':', turn), coalesce(text, '') FROM conversations)"""

LINES = r"""line AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
    lambda x: regexp_matches(x, '\S'))) AS text, generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
    lambda x: regexp_matches(x, '\S')), 1) - 1 AS i FROM documents)"""

PAIRS = """pair AS (SELECT a.request_id, a.block_index AS a_index, b.block_index AS b_index, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
    b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
    least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h
  FROM box a JOIN box b ON a.request_id = b.request_id AND a.block_index <> b.block_index),
lap AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 0.0::DOUBLE
    ELSE CAST(w * h AS DOUBLE) / (greatest(1, (ax2 - ax1) * (ay2 - ay1)) + greatest(1, (bx2 - bx1) * (by2 - by1)) - w * h) END AS iou FROM pair)"""

SQL: dict[str, str] = {}
SQL["text_to_blocks"] = f"WITH {LINES} SELECT doc_id AS request_id, CAST(i AS INT) AS block_index, text, 0 AS x1, 0 AS y1, 0.0::DOUBLE AS confidence FROM line"
SQL["download_names"] = r"""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'rule-evaluate' ELSE CAST(page_id AS VARCHAR) END AS request_id,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*?(\.[A-Za-z0-9]+)$', 1) AS suffix FROM pages)
SELECT page_id, request_id, md5(concat(request_id, ':', url)) || CASE WHEN suffix = '' THEN '.jpg' ELSE suffix END AS file_name FROM p"""
SQL["keyword_hits"] = f"WITH {BOXES} SELECT request_id, block_index, {_joined(_hits(MEDICAL))} AS medical, {_joined(_hits(ILLEGAL))} AS illegal FROM box"
SQL["alias_hits"] = f"WITH {BOXES} SELECT request_id, block_index, {_joined(_aliases(MEDICAL_ALIASES))} AS medical, {_joined(_aliases(ILLEGAL_ALIASES))} AS illegal FROM box"
SQL["noise_hits"] = f"WITH {BOXES} SELECT request_id, block_index, {_joined(_hits((*NOISE, *NOISE_OF_BOXES)))} AS noise, {_joined(_hits((*NOISE, *NOISE_OF_READINGS)))} AS reading_noise FROM box"
for _name, _column in (("phone_extract", "phones"), ("wechat_extract", "wechat_ids"), ("qq_extract", "qqs")):
    SQL[_name] = f"WITH {EVIDENCE} SELECT request_id, block_index, {_joined(_column)} AS {_column} FROM ev"
SQL["block_annotations"] = f"WITH {EVIDENCE} SELECT request_id, block_index, len(hit_rules) > 0 AS matched, {_joined('hit_keywords')} AS hit_keywords, {_joined('hit_rules')} AS hit_rules, {_joined('clue_types')} AS clue_types FROM an"
_ROLLED = ", ".join(f"{_joined(_set(f'flatten(list({c}))'))} AS {c}" for c in ("phones", "wechat_ids", "qqs", "hit_keywords", "hit_rules"))
SQL["document_rollup"] = f"WITH {EVIDENCE} SELECT request_id, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY block_index) AS ocr_text, {_ROLLED} FROM an GROUP BY request_id"
SQL["meaningful_text"] = rf"""WITH {TEXTS} SELECT kind, id, regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]{{2,}}') AS meaningful,
  CAST(length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g')) AS BIGINT) AS solid_length,
  regexp_matches(text, '\p{{Nd}}{{7,}}') AS phone_digits, regexp_matches(text, '(?i)微信|vx|wechat|QQ|手机|电话|1[3-9][0-9]{{5,}}') AS partial_contact FROM t"""
SQL["punctuation_noise"] = rf"""WITH {LINES}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM line)
SELECT doc_id AS request_id, count(*) AS words, count(*) FILTER (trim(word, ' ' || chr(9) || chr(11) || chr(12)) <> '' AND NOT regexp_matches(word, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]')) AS noise_words FROM w GROUP BY doc_id"""
SQL["text_normalize"] = rf"WITH {BOXES} SELECT request_id, block_index, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS normalized FROM box"
SQL["similar_text_pairs"] = rf"""WITH {BOXES}, n AS (SELECT request_id, block_index, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS t FROM box),
p AS (SELECT a.request_id, a.block_index AS a_index, b.block_index AS b_index, a.t AS a, b.t AS b,
  CASE WHEN length(a.t) <= length(b.t) THEN a.t ELSE b.t END AS s, CASE WHEN length(a.t) <= length(b.t) THEN b.t ELSE a.t END AS l
  FROM n a JOIN n b ON a.request_id = b.request_id AND a.block_index < b.block_index)
SELECT request_id, a_index, b_index FROM p WHERE a <> '' AND b <> '' AND (a = b OR contains(a, b) OR contains(b, a)
  OR (length(s) >= 3 AND len(list_filter(range(1, length(s) + 1), lambda i: s[i] = l[i])) / length(s) >= 0.65))"""
SQL["box_geometry"] = f"""WITH {BOXES}, c AS (SELECT *, least(greatest(0, x1), 499) AS clip_x1, least(greatest(0, y1), 599) AS clip_y1 FROM box)
SELECT request_id, block_index, x1, y1, x2, y2, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, x1 - 10 AS wide_x1, y2 + 20 AS wide_y2,
  clip_x1, clip_y1, least(greatest(clip_x1 + 1, x2), 500) AS clip_x2, least(greatest(clip_y1 + 1, y2), 600) AS clip_y2, 0.0::DOUBLE AS angle FROM c"""
SQL["turned_boxes"] = """WITH d AS (SELECT p_partkey, 2 + p_partkey % 7 AS s, 1 + p_partkey % 5 AS t, [4, 12, 5, 3, 1, -4][p_partkey % 6 + 1] AS dx, [3, 5, 12, -4, 0, 3][p_partkey % 6 + 1] AS dy,
  100 + p_partkey % 300 AS x, 100 + p_partkey % 200 AS y FROM part),
a AS (SELECT *, degrees(atan2(dy, dx)) - 90 * floor(degrees(atan2(dy, dx)) / 90) AS deg FROM d)
SELECT p_partkey, round(CASE WHEN deg > 45 THEN deg - 90 ELSE deg END, 6) AS angle, CAST(least(x, x + dx * s, x + dx * s - dy * t, x - dy * t) AS INT) AS x1, CAST(least(y, y + dy * s, y + dy * s + dx * t, y + dx * t) AS INT) AS y1,
  CAST(greatest(x, x + dx * s, x + dx * s - dy * t, x - dy * t) AS INT) AS x2, CAST(greatest(y, y + dy * s, y + dy * s + dx * t, y + dx * t) AS INT) AS y2, 'rectangle' AS shape FROM a"""
SQL["oblique_texts"] = "WITH t AS (" + SQL["turned_boxes"] + r"""), b AS (SELECT p_partkey // 5 AS request_id, p_partkey % 5 AS i, ['8', '甲 乙', 'no 12345', '--', '保'][p_partkey * 7 % 5 + 1] AS text, angle, x1, y1, x2, y2 FROM t),
m AS (SELECT *, median((y1 + y2) / 2) OVER (PARTITION BY request_id) AS middle, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h, replace(text, ' ', '') AS bare FROM b)
SELECT request_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (length(bare) <= 4 AND regexp_matches(bare, '[\x{4e00}-\x{9fff}A-Za-z0-9]') AND abs(angle) >= 20
  AND (y1 + y2) / 2 >= middle + greatest(40.0, h * 0.6) AND (regexp_matches(bare, '[0-9]') OR greatest(w, h) / least(w, h) >= 1.15)), '') AS oblique FROM m GROUP BY request_id"""
SQL["iou_pairs"] = f"""WITH {BOXES}, {PAIRS} SELECT request_id, a_index, b_index, round(iou, 6) AS iou,
  abs((ax1 + ax2) - (bx1 + bx2)) <= 24 AND abs((ay1 + ay2) - (by1 + by2)) <= 24 AS close,
  round(sqrt(((ax1 + ax2) / 2 - (bx1 + bx2) / 2) ** 2 + ((ay1 + ay2) / 2 - (by1 + by2) / 2) ** 2), 4) AS distance FROM lap WHERE a_index < b_index AND w >= 0 AND h >= 0"""
SQL["nearby_boxes"] = f"""WITH {BOXES}, {PAIRS}, pad AS (SELECT *, greatest(12, CAST(trunc((ax2 - ax1) * 0.14::DOUBLE) AS INT)) AS px, greatest(12, CAST(trunc((ay2 - ay1) * 0.14::DOUBLE) AS INT)) AS py FROM lap)
SELECT request_id, a_index, b_index FROM pad WHERE ((bx1 + bx2) / 2 BETWEEN ax1 - px AND ax2 + px AND (by1 + by2) / 2 BETWEEN ay1 - py AND ay2 + py) OR iou >= 0.08"""
CARDS = """cd AS (SELECT request_id, block_index // 2 AS card, CASE WHEN block_index = 0 THEN x1 - 40 ELSE x1 END AS x1, CASE WHEN block_index = 0 THEN y1 - 60 ELSE y1 END AS y1,
  CASE WHEN block_index = 0 THEN x2 + 40 ELSE x2 END AS x2, CASE WHEN block_index = 0 THEN y2 + 60 ELSE y2 END AS y2 FROM box WHERE request_id % 3 = 0 AND block_index IN (0, 2)),
cwide AS (SELECT request_id, card, x1 - greatest(10, (x2 - x1) // 8) AS x1, y1 - greatest(10, (y2 - y1) // 8) AS y1, x2 + greatest(10, (x2 - x1) // 8) AS x2, y2 + greatest(10, (y2 - y1) // 8) AS y2 FROM cd),
con AS (SELECT w.request_id, w.card, b.block_index FROM cwide w JOIN box b ON w.request_id = b.request_id
  AND (((b.x1 + b.x2) / 2 BETWEEN w.x1 AND w.x2 AND (b.y1 + b.y2) / 2 BETWEEN w.y1 AND w.y2) OR NOT (w.x2 < b.x1 OR w.x1 > b.x2 OR w.y2 < b.y1 OR w.y1 > b.y2)))"""
SQL["card_boxes"] = f"WITH {BOXES}, {CARDS} SELECT request_id, CAST(card AS INT) AS card, block_index FROM con"
SQL["card_candidates"] = f"""WITH {BOXES}, f AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM box), g AS (SELECT * FROM f WHERE w * h BETWEEN 900000 * 0.0012 AND 900000 * 0.35 AND w >= 28 AND h >= 28 AND w <= 810 AND h <= 900
  AND x1 > 1 AND y1 > 1 AND x2 < 899 AND y2 < 999 AND greatest(w / greatest(h, 1), h / greatest(w, 1)) <= 6.5),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request_id, x1 // 12, y1 // 12, x2 // 12, y2 // 12 ORDER BY block_index) = 1)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY w * h DESC, block_index) - 1 AS INT) AS card, x1, y1, x2, y2 FROM k QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY w * h DESC, block_index) <= 12"""
SQL["best_retry"] = f"""WITH {BOXES} SELECT request_id, block_index AS ordinal, x1 % 7 AS semantic_score, confidence, y1 % 3 AS boxes FROM box
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY x1 % 7 DESC, confidence DESC, y1 % 3 DESC, block_index) = 1"""
SQL["recognised_boxes"] = f"WITH {BOXES} SELECT request_id, block_index, text, confidence, x1, y1, x2, y2 FROM box"
SQL["core_items"] = f"""WITH {EVIDENCE} SELECT request_id, block_index, keyword FROM an a WHERE keyword OR (len(noise) = 0 AND NOT contact AND EXISTS (
  SELECT 1 FROM an b WHERE b.request_id = a.request_id AND b.keyword
  AND sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) <= 90))"""
SQL["reading_order"] = f"""WITH {BOXES} SELECT request_id, string_agg(CAST(block_index AS VARCHAR), ',' ORDER BY y1, x1, block_index) AS ordered,
  CAST((2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10000 AS confidence FROM box GROUP BY request_id"""

# Text requests in closed form: all boxes lie at one point, so there is one region at most, of all boxes but pure noise.
TEXT_ONLY = rf"""{EVIDENCE},
d AS (SELECT *, len(noise) > 0 AND NOT keyword AND NOT contact AS quiet,
  min(CASE WHEN keyword OR contact THEN block_index END) OVER (PARTITION BY request_id) AS anchor,
  bool_or(len(noise) > 0) OVER (PARTITION BY request_id) AS noisy, bool_or(keyword) OVER (PARTITION BY request_id) AS worded FROM an),
m AS (SELECT *, CASE WHEN block_index = anchor THEN -1 ELSE block_index END AS k FROM d WHERE anchor IS NOT NULL AND NOT quiet),
c AS (SELECT request_id, string_agg(text, '' ORDER BY k) AS text, list(text) AS singles, flatten(list(medical)) AS med, flatten(list(illegal)) AS ill,
  first(phones ORDER BY k) FILTER (worded AND NOT noisy AND len(phones) > 0) AS p, first(wechat_ids ORDER BY k) FILTER (worded AND NOT noisy AND len(wechat_ids) > 0) AS v,
  first(qqs ORDER BY k) FILTER (worded AND NOT noisy AND len(qqs) > 0) AS q FROM m GROUP BY request_id),
r AS (SELECT request_id, {_set(f"list_concat(med, {_hits(MEDICAL)}, {_aliases(MEDICAL_ALIASES)})")} AS medical,
  {_set(f"list_concat(ill, {_hits(ILLEGAL)}, {_aliases(ILLEGAL_ALIASES)}, CASE WHEN list_contains(singles, '取') AND list_contains(singles, '现') THEN ['取现'] ELSE [] END, CASE WHEN list_contains(singles, '提') AND list_contains(singles, '现') THEN ['提现'] ELSE [] END)")} AS illegal,
  len(coalesce(p, [])) > 0 OR len(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([^0-9\-\s])', '\1\1', 'g'), '{PHONE}', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) = 11 AND starts_with(x, '1'))) > 0 AS phone,
  len(coalesce(v, [])) > 0 AS wechat, len(coalesce(q, [])) > 0 AS qq FROM c),
s AS (SELECT *, CASE WHEN len(medical) > 0 THEN least(35, 12 + 6 * len(medical)) ELSE 0 END + CASE WHEN len(illegal) > 0 THEN least(40, 15 + 8 * len(illegal)) ELSE 0 END
  + CASE WHEN phone THEN 24 ELSE 0 END + CASE WHEN wechat THEN 18 ELSE 0 END + CASE WHEN qq THEN 16 ELSE 0 END
  + CASE WHEN len(medical) > 0 AND (phone OR wechat OR qq) THEN 20 ELSE 0 END + CASE WHEN len(medical) > 0 AND len(illegal) > 0 THEN 12 ELSE 0 END
  + CASE WHEN len(illegal) >= 2 THEN 10 ELSE 0 END AS raw,
  list_filter([CASE WHEN len(medical) > 0 AND (phone OR wechat OR qq) THEN 'combo.medical_contact' END, CASE WHEN len(medical) > 0 AND len(illegal) > 0 THEN 'combo.medical_illegal' END,
    CASE WHEN len(illegal) >= 2 THEN 'combo.multi_illegal' END, CASE WHEN phone THEN 'contact.phone' END, CASE WHEN qq THEN 'contact.qq' END, CASE WHEN wechat THEN 'contact.wechat' END,
    CASE WHEN len(illegal) > 0 THEN 'illegal.keyword' END, CASE WHEN len(medical) > 0 THEN 'medical.keyword' END], lambda x: x IS NOT NULL) AS rules FROM r),
ad AS (SELECT *, least(100, CASE WHEN len(medical) > 0 THEN greatest(raw, 45) ELSE raw END) AS score FROM s WHERE raw > 0),
doc AS (SELECT request_id, count(*) AS n_blocks, flatten(list(phones)) AS phones, flatten(list(wechat_ids)) AS wechat_ids, flatten(list(qqs)) AS qqs,
  flatten(list(hit_keywords)) AS hit_keywords, flatten(list(hit_rules)) AS hit_rules, bool_or(noisy) AS noisy, bool_or(worded) AS worded, bool_or(anchor IS NOT NULL) AS anchored FROM d GROUP BY request_id)"""
_LISTED = ", ".join(f"{_joined(_set(f'doc.{c}'))} AS {c}" for c in ("phones", "wechat_ids", "qqs"))
SQL["text_only_evaluation"] = rf"""WITH {TEXT_ONLY}
SELECT doc.request_id, n_blocks, CASE WHEN ad.request_id IS NULL THEN 0 ELSE 1 END AS n_ads, CAST(coalesce(score, 0) AS INT) AS risk_score,
  CASE WHEN score >= 80 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS risk_level, coalesce(score >= 45 OR (len(medical) > 0 AND len(illegal) > 0), false) AS suspicious,
  CASE WHEN ad.request_id IS NOT NULL THEN '' WHEN NOT anchored THEN 'no_groups' WHEN len(doc.phones) > 0 AND NOT worded THEN 'phone_only_without_business_keywords'
    WHEN noisy THEN 'noise_keywords' ELSE 'all_groups_filtered' END AS empty_reason, {_LISTED},
  {_joined(_set("list_concat(hit_keywords, coalesce(medical, []), coalesce(illegal, []))"))} AS hit_keywords, {_joined(_set("list_concat(hit_rules, coalesce(rules, []))"))} AS hit_rules
FROM doc LEFT JOIN ad ON doc.request_id = ad.request_id"""

# A request for each box: the closed form holds for one box anywhere.
_ONE = "one AS (SELECT request_id * 100 + block_index AS request_id, 0 AS block_index, text, x1, y1, x2, y2, confidence, block_index AS ordinal FROM box),\nev AS (SELECT"
SQL["json_requests"] = SQL["text_only_evaluation"].replace("ev AS (SELECT", _ONE, 1).replace(" AS noise FROM box)", " AS noise FROM one)").replace(
    "SELECT doc.request_id, n_blocks,", "SELECT CAST(doc.request_id AS VARCHAR) AS request_id, CASE doc.request_id % 100 % 4 WHEN 2 THEN 'same' WHEN 3 THEN CAST(doc.request_id AS VARCHAR) ELSE 'rule-evaluate' END AS shown_id, n_blocks,"
)

SQL["stream_documents"] = SQL["text_only_evaluation"].replace("SELECT doc.request_id, n_blocks,", "SELECT CAST(doc.request_id AS VARCHAR) AS request_id, n_blocks,")
SQL["request_files"] = f"""WITH {BOXES}, l AS (SELECT request_id, request_id % 7 AS k, count(*) AS n FROM box GROUP BY request_id),
r AS (SELECT CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'no_content' WHEN 2 THEN 'no_box_text' WHEN 3 THEN 'bad_points' ELSE '' END AS rejected, CASE WHEN k < 2 THEN 0 ELSE n END AS boxes, k FROM l)
SELECT rejected, count(*) AS lines, CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (k > 0) AS with_id FROM r GROUP BY rejected"""

_KINDS = {"card": ((32, 0.18), (24, 0.18), (28, 0.14), (36, 0.18)), "wide": ((80, 0.85), (60, 0.35), (70, 0.40), (120, 0.95)), "box": ((24, 1.0), (24, 1.0), (28, 1.0), (28, 1.0)),
          "turned": ((12, 0.10), (12, 0.10), (8, 0.04), (20, 0.28)), "side": ((12, 0.14),) * 4}
_FRAMES = " UNION ALL ".join(
    f"SELECT request_id, block_index, '{k}' AS kind, x1 - greatest({p[0][0]}, CAST(trunc(w * {p[0][1]}::DOUBLE) AS INT)) AS a, y1 - greatest({p[2][0]}, CAST(trunc(h * {p[2][1]}::DOUBLE) AS INT)) AS b, "
    f"x2 + greatest({p[1][0]}, CAST(trunc(w * {p[1][1]}::DOUBLE) AS INT)) AS c, y2 + greatest({p[3][0]}, CAST(trunc(h * {p[3][1]}::DOUBLE) AS INT)) AS d FROM s"
    for k, p in _KINDS.items()
)
SQL["focus_frames"] = f"""WITH {BOXES}, s AS (SELECT *, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h FROM box), f AS ({_FRAMES}),
g AS (SELECT *, least(greatest(0, a), 899) AS x1, least(greatest(0, b), 999) AS y1 FROM f)
SELECT request_id, block_index, kind, x1, y1, least(greatest(x1 + 1, c), 900) AS x2, least(greatest(y1 + 1, d), 1000) AS y2 FROM g"""

# Spatial evaluation: order-dependent folds as recursive queries, one step for each anchor or ad of a request.


def _iou(a: str, b: str) -> str:
    w, h = (f"(least({a}.{c}2, {b}.{c}2) - greatest({a}.{c}1, {b}.{c}1))" for c in "xy")
    area = lambda r: f"greatest(1, ({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1))"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0::DOUBLE ELSE CAST({w} * {h} AS DOUBLE) / ({area(a)} + {area(b)} - {w} * {h}) END"


def _same_boxes(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) >= greatest(1, least(len({a}), len({b})) // 2)"


def _far(a: str, b: str) -> str:
    return f"sqrt((({a}.x1 + {a}.x2) / 2 - ({b}.x1 + {b}.x2) / 2) ** 2 + (({a}.y1 + {a}.y2) / 2 - ({b}.y1 + {b}.y2) / 2) ** 2)"


def _cut(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


_FRAME = "min(m.x1) AS x1, min(m.y1) AS y1, max(m.x2) AS x2, max(m.y2) AS y2"
REGIONS = rf"""{EVIDENCE},
bl AS MATERIALIZED (SELECT *, len(noise) > 0 AS noisy, contact OR len(contact_hits) > 0 OR regexp_matches(text, '\p{{Nd}}{{6,}}') AS contact_like FROM an),
near AS (SELECT a.request_id, a.block_index AS anchor, m.*
  FROM bl a JOIN bl m ON m.request_id = a.request_id AND (m.block_index = a.block_index OR (NOT (m.noisy AND NOT m.keyword AND NOT m.contact)
    AND abs((m.x1 + m.x2) / 2 - (a.x1 + a.x2) / 2) <= greatest(70, {_cut("greatest(20, a.x2 - a.x1) * 2.2::DOUBLE")})
    AND abs((m.y1 + m.y2) / 2 - (a.y1 + a.y2) / 2) <= greatest(120, {_cut("greatest(20, a.y2 - a.y1) * 5.0::DOUBLE")})))
  WHERE a.keyword OR a.contact),
around AS (SELECT request_id, anchor, list(m.block_index ORDER BY m.block_index <> anchor, m.block_index) AS members, {_FRAME} FROM near m GROUP BY request_id, anchor),
cand AS MATERIALIZED (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY anchor) AS n, count(*) OVER (PARTITION BY request_id) AS anchors, anchor, members,
  x1 - greatest(12, {_cut("(x2 - x1) * 0.18::DOUBLE")}) AS x1, y1 - greatest(12, {_cut("(y2 - y1) * 0.2::DOUBLE")}) AS y1,
  x2 + greatest(12, {_cut("(x2 - x1) * 0.18::DOUBLE")}) AS x2, y2 + greatest(12, {_cut("(y2 - y1) * 0.2::DOUBLE")}) AS y2 FROM around),
fold AS (SELECT request_id, CAST(1 AS BIGINT) AS n, anchors, members AS used,
    [struct_pack(anchor := anchor, members := members, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM cand WHERE n = 1
  UNION ALL
  SELECT f.request_id, c.n, f.anchors, CASE WHEN list_contains(f.used, c.anchor) THEN f.used ELSE list_distinct(list_concat(f.used, c.members)) END,
    CASE WHEN list_contains(f.used, c.anchor) OR len(list_filter(f.kept, lambda k: {_iou("k", "c")} >= 0.35 OR {_same_boxes("k.members", "c.members")})) > 0 THEN f.kept
      ELSE list_append(f.kept, struct_pack(anchor := c.anchor, members := c.members, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2)) END
  FROM fold f JOIN cand c ON c.request_id = f.request_id AND c.n = f.n + 1),
reg AS MATERIALIZED (SELECT request_id, unnest(range(len(kept))) AS region, unnest(kept) AS r FROM fold WHERE n = anchors)"""
SQL["text_regions"] = f"WITH RECURSIVE {REGIONS} SELECT request_id, CAST(region AS INT) AS region, r.anchor, {_joined('r.members')} AS members, r.x1, r.y1, r.x2, r.y2 FROM reg"

_PHONES_OF_TEXT = rf"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([^0-9\-\s])', '\1\1', 'g'), '{PHONE}', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) = 11 AND starts_with(x, '1'))"
SCORED = rf"""{REGIONS},
it AS MATERIALIZED (SELECT g.request_id, g.region, g.k, b.* EXCLUDE (request_id) FROM (SELECT request_id, region, unnest(r.members) AS i, unnest(range(len(r.members))) AS k FROM reg) g
  JOIN bl b ON b.request_id = g.request_id AND b.block_index = g.i),
core AS MATERIALIZED (SELECT * FROM it c WHERE keyword OR (NOT noisy AND NOT contact AND EXISTS (SELECT 1 FROM it w WHERE w.request_id = c.request_id AND w.region = c.region AND w.keyword AND {_far("c", "w")} <= 90))),
mid AS (SELECT request_id, region, greatest(1.0::DOUBLE, sqrt(CAST((max(x2) - min(x1)) ** 2 + (max(y2) - min(y1)) ** 2 AS DOUBLE))) AS diag,
  avg((x1 + x2) / 2) AS cx, avg((y1 + y2) / 2) AS cy FROM core GROUP BY request_id, region),
att AS (SELECT c.request_id, c.region, c.k, c.block_index, c.phones, c.wechat_ids, c.qqs, m.diag, min({_far("c", "o")}) AS nearest,
    (c.y1 + c.y2) / 2 >= m.cy - 20 AND abs((c.x1 + c.x2) / 2 - m.cx) <= greatest(60.0::DOUBLE, m.diag * 0.4::DOUBLE) AS below,
    c.noisy OR EXISTS (SELECT 1 FROM bl b WHERE b.request_id = c.request_id AND b.noisy AND b.block_index <> c.block_index AND {_far("c", "b")} <= 85) AS noisy
  FROM it c JOIN mid m ON m.request_id = c.request_id AND m.region = c.region JOIN core o ON o.request_id = c.request_id AND o.region = c.region WHERE c.contact_like GROUP BY ALL),
ats AS MATERIALIZED (SELECT *, CAST(printf('%.4f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.24::DOUBLE + 0.12::DOUBLE + greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, nearest / diag)) * 0.20::DOUBLE
    + CASE WHEN nearest <= 80 THEN 1.0 ELSE 0.35 END::DOUBLE * 0.16::DOUBLE + CASE WHEN below THEN 0.8 ELSE 0.4 END::DOUBLE * 0.16::DOUBLE - CASE WHEN noisy THEN 0.35 ELSE 0.0 END::DOUBLE))) AS DOUBLE) AS score FROM att),
best AS (SELECT request_id, region, first(phones ORDER BY score DESC, k) FILTER (len(phones) > 0) AS p, first(wechat_ids ORDER BY score DESC, k) FILTER (len(wechat_ids) > 0) AS v,
  first(qqs ORDER BY score DESC, k) FILTER (len(qqs) > 0) AS q FROM ats WHERE score >= 0.55 GROUP BY request_id, region),
txt AS (SELECT i.request_id, i.region, string_agg(trim(text), '' ORDER BY (y1 + y2) / 2, x1, i.k) AS text, list(trim(text)) AS singles, flatten(list(medical)) AS med, flatten(list(illegal)) AS ill FROM it i GROUP BY i.request_id, i.region),
rw AS (SELECT t.request_id, t.region, t.text, {_set(f"list_concat(med, {_hits(MEDICAL)}, {_aliases(MEDICAL_ALIASES)})")} AS medical,
  {_set(f"list_concat(ill, {_hits(ILLEGAL)}, {_aliases(ILLEGAL_ALIASES)}, CASE WHEN list_contains(singles, '取') AND list_contains(singles, '现') THEN ['取现'] ELSE [] END, CASE WHEN list_contains(singles, '提') AND list_contains(singles, '现') THEN ['提现'] ELSE [] END)")} AS illegal,
  {_set(f"list_concat(coalesce(p, []), {_PHONES_OF_TEXT})")} AS phones, coalesce(v, []) AS wechat_ids, coalesce(q, []) AS qqs
  FROM txt t LEFT JOIN best b ON b.request_id = t.request_id AND b.region = t.region),
rf AS (SELECT *, len(phones) > 0 AS phone, len(wechat_ids) > 0 AS wechat, len(qqs) > 0 AS qq FROM rw),
rs AS (SELECT *, CASE WHEN len(medical) > 0 THEN least(35, 12 + 6 * len(medical)) ELSE 0 END + CASE WHEN len(illegal) > 0 THEN least(40, 15 + 8 * len(illegal)) ELSE 0 END
  + CASE WHEN phone THEN 24 ELSE 0 END + CASE WHEN wechat THEN 18 ELSE 0 END + CASE WHEN qq THEN 16 ELSE 0 END
  + CASE WHEN len(medical) > 0 AND (phone OR wechat OR qq) THEN 20 ELSE 0 END + CASE WHEN len(medical) > 0 AND len(illegal) > 0 THEN 12 ELSE 0 END + CASE WHEN len(illegal) >= 2 THEN 10 ELSE 0 END AS raw,
  list_filter([CASE WHEN len(medical) > 0 AND (phone OR wechat OR qq) THEN 'combo.medical_contact' END, CASE WHEN len(medical) > 0 AND len(illegal) > 0 THEN 'combo.medical_illegal' END,
    CASE WHEN len(illegal) >= 2 THEN 'combo.multi_illegal' END, CASE WHEN phone THEN 'contact.phone' END, CASE WHEN qq THEN 'contact.qq' END, CASE WHEN wechat THEN 'contact.wechat' END,
    CASE WHEN len(illegal) > 0 THEN 'illegal.keyword' END, CASE WHEN len(medical) > 0 THEN 'medical.keyword' END], lambda x: x IS NOT NULL) AS rules FROM rf),
sc AS MATERIALIZED (SELECT *, CAST(least(100, CASE WHEN len(medical) > 0 THEN greatest(raw, 45) ELSE raw END) AS INT) AS score FROM rs)"""
SQL["contact_attachment"] = f"WITH RECURSIVE {SCORED} SELECT request_id, CAST(region AS INT) AS region, block_index, score, score >= 0.55 AS accepted FROM ats"
# The colours behind boxes: three numbers each for mean and spread, none for every fifth box.
_GAP = "sqrt((c.{0}[1] - o.{0}[1]) ** 2 + (c.{0}[2] - o.{0}[2]) ** 2 + (c.{0}[3] - o.{0}[3]) ** 2)"
_ALIKE = f"CASE WHEN c.mean IS NULL OR o.mean IS NULL THEN 5000 ELSE CAST(round_even(greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, {_GAP.format('mean')} / 100 * 0.75::DOUBLE + {_GAP.format('spread')} / 60 * 0.25::DOUBLE)) * 10000, 0) AS BIGINT) END"
_SIGNED = (
    SCORED.replace(" AS confidence FROM lineitem)", """ AS confidence,
  [CAST(l_partkey * 13 % 256 AS DOUBLE), CAST(l_suppkey * 7 % 256 AS DOUBLE), CAST((l_partkey * 3 + l_linenumber) % 256 AS DOUBLE)] AS mean, [CAST(l_partkey % 60 AS DOUBLE), CAST(l_suppkey % 50 AS DOUBLE), CAST(l_linenumber * 9 % 40 AS DOUBLE)] AS spread FROM lineitem)""", 1)
    .replace("bl AS MATERIALIZED (SELECT *,", "bl AS MATERIALIZED (SELECT * REPLACE (CASE WHEN block_index % 5 <> 4 THEN mean END AS mean),", 1)
    .replace(" AS nearest,", f" AS nearest, round_even(CAST(sum({_ALIKE}) AS DOUBLE) / count(*), 0) / 10000 AS background,", 1)
    .replace("0.24::DOUBLE + 0.12::DOUBLE +", "0.24::DOUBLE + background * 0.24::DOUBLE +", 1)
)
SQL["background_attachment"] = f"""WITH RECURSIVE {_SIGNED} SELECT request_id, CAST(region AS INT) AS region, block_index, score, background,
  CASE WHEN noisy AND score < 0.6 THEN 'noise_nearby' WHEN background < 0.45 THEN 'background_mismatch' WHEN score < 0.55 THEN 'low_attachment_score' ELSE '' END AS reason FROM ats"""
SQL["region_score"] = f"""WITH RECURSIVE {SCORED} SELECT request_id, CAST(region AS INT) AS region, text AS combined, score AS risk_score,
  {", ".join(f"{_joined(c)} AS {c}" for c in ("medical", "illegal", "phones", "wechat_ids", "qqs"))}, {_joined("rules")} AS hit_rules FROM sc"""

def _rectangles(rows: str, p: str = "") -> str:
    """{p}rect: center (x, y), sides (w, h), direction (ux, uy) and its length n of the smallest rectangle around the points of each
    (request_id, region). The least area over the directions of all pairs of points is that over the edges of the hull."""
    points = f"{p}pt"
    return f"""{points} AS MATERIALIZED ({rows}),
{p}pd AS (SELECT a.request_id, a.region, b.x - a.x AS dx, b.y - a.y AS dy FROM {points} a JOIN {points} b ON b.request_id = a.request_id AND b.region = a.region),
{p}pu AS (SELECT *, abs(dy) > abs(dx) OR (abs(dy) = abs(dx) AND dx * dy < 0) AS swap FROM {p}pd),
{p}pv AS (SELECT request_id, region, CASE WHEN swap THEN dy ELSE dx END AS ux, CASE WHEN swap THEN -dx ELSE dy END AS uy FROM {p}pu),
{p}pw AS (SELECT request_id, region, CASE WHEN ux > 0 THEN ux ELSE -ux END AS ux, CASE WHEN ux > 0 THEN uy ELSE -uy END AS uy FROM {p}pv),
{p}pn AS MATERIALIZED (SELECT DISTINCT request_id, region, CAST(CASE WHEN uy = 0 THEN 1 ELSE ux // gcd(ux, abs(uy)) END AS BIGINT) AS ux, CAST(CASE WHEN uy = 0 THEN 0 WHEN uy < 0 THEN -(-uy // gcd(ux, abs(uy))) ELSE uy // gcd(ux, abs(uy)) END AS BIGINT) AS uy FROM {p}pw),
{p}pe AS (SELECT d.request_id, d.region, ux, uy, min(p.x * ux + p.y * uy) AS a1, max(p.x * ux + p.y * uy) AS a2, min(p.y * ux - p.x * uy) AS b1, max(p.y * ux - p.x * uy) AS b2, CAST(ux * ux + uy * uy AS DOUBLE) AS sq
  FROM {p}pn d JOIN {points} p ON p.request_id = d.request_id AND p.region = d.region GROUP BY d.request_id, d.region, ux, uy),
{p}pb AS (SELECT * FROM {p}pe QUALIFY row_number() OVER (PARTITION BY request_id, region ORDER BY CAST(a2 - a1 AS DOUBLE) * (b2 - b1) / sq, abs(CAST(uy AS DOUBLE) / ux), CAST(uy AS DOUBLE) / ux) = 1),
{p}rect AS MATERIALIZED (SELECT request_id, region, CAST(ux AS DOUBLE) AS ux, CAST(uy AS DOUBLE) AS uy, sqrt(sq) AS n, CAST(a2 - a1 AS DOUBLE) / sqrt(sq) AS w, CAST(b2 - b1 AS DOUBLE) / sqrt(sq) AS h,
  ux * (CAST(a1 + a2 AS DOUBLE) / 2 / sq) - uy * (CAST(b1 + b2 AS DOUBLE) / 2 / sq) AS x, uy * (CAST(a1 + a2 AS DOUBLE) / 2 / sq) + ux * (CAST(b1 + b2 AS DOUBLE) / 2 / sq) AS y FROM {p}pb)"""


def _corners(w: str, h: str) -> str:
    """Corners of a rectangle of rect with these sides, rounded half to even."""
    at = lambda sx, sy: f"[CAST(round_even(x + {sx} * ({w} / 2) * ux / n - {sy} * ({h} / 2) * uy / n, 0) AS INT), CAST(round_even(y + {sx} * ({w} / 2) * uy / n + {sy} * ({h} / 2) * ux / n, 0) AS INT)]"
    return f"[{at('-1', '-1')}, {at('1', '-1')}, {at('1', '1')}, {at('-1', '1')}]"


_AD = "struct_pack(ad_index := {n}, poly := c.poly, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2, ids := c.ids, words := c.words, rules := c.rules, phones := c.phones, wechat_ids := c.wechat_ids, qqs := c.qqs, score := c.score, bad := c.bad)"
_AGAIN = f"list_position(list_transform(f.kept, lambda k: {_iou('k', 'c')} >= 0.45 OR {_same_boxes('k.ids', 'c.ids')}), true)"
ADS = rf"""{SCORED},
own AS (SELECT i.*, NOT i.contact_like OR coalesce(a.score >= 0.55, false) AS stays FROM it i LEFT JOIN ats a ON a.request_id = i.request_id AND a.region = i.region AND a.k = i.k),
base AS MATERIALIZED (SELECT * EXCLUDE (any_stays) FROM (SELECT *, bool_or(stays) OVER (PARTITION BY request_id, region) AS any_stays FROM own) WHERE stays OR NOT any_stays),
bf AS (SELECT request_id, region, list(block_index) AS taken, {_FRAME} FROM base m GROUP BY request_id, region),
wd AS (SELECT request_id, region, taken, x1 - px AS x1, y1 - py AS y1, x2 + px AS x2, y2 + py AS y2 FROM (SELECT *, greatest(40, {_cut("greatest(40, x2 - x1) * 0.35::DOUBLE")}) AS px, greatest(40, {_cut("greatest(40, y2 - y1) * 0.35::DOUBLE")}) AS py FROM bf)),
adb AS (SELECT request_id, region, 0 AS part, k, block_index, x1, y1, x2, y2 FROM base
  UNION ALL SELECT b.request_id, w.region, 1, b.block_index, b.block_index, b.x1, b.y1, b.x2, b.y2 FROM wd w JOIN bl b ON b.request_id = w.request_id AND b.keyword AND NOT list_contains(w.taken, b.block_index)
    AND (((b.x1 + b.x2) / 2 BETWEEN w.x1 AND w.x2 AND (b.y1 + b.y2) / 2 BETWEEN w.y1 AND w.y2) OR NOT (w.x2 < b.x1 OR w.x1 > b.x2 OR w.y2 < b.y1 OR w.y1 > b.y2))),
af AS (SELECT request_id, region, list(block_index ORDER BY part, k) AS ids, {_FRAME} FROM adb m GROUP BY request_id, region),
{_rectangles("SELECT DISTINCT request_id, region, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM adb")},
up AS (SELECT request_id, region, list_transform({_corners("greatest(w, 24) * 1.55::DOUBLE", "greatest(h, 24) * 1.8::DOUBLE")}, lambda p: [greatest(0, p[1]), greatest(0, p[2])]) AS poly FROM rect),
adc AS MATERIALIZED (SELECT u.request_id, row_number() OVER (PARTITION BY u.request_id ORDER BY u.region) AS n, count(*) OVER (PARTITION BY u.request_id) AS total, f.ids, u.poly,
    list_min(list_transform(u.poly, lambda p: p[1])) AS x1, list_min(list_transform(u.poly, lambda p: p[2])) AS y1, list_max(list_transform(u.poly, lambda p: p[1])) AS x2, list_max(list_transform(u.poly, lambda p: p[2])) AS y2,
    {_set("list_concat(s.medical, s.illegal)")} AS words, s.rules, s.phones, s.wechat_ids, s.qqs, s.score, s.score >= 45 OR (len(s.medical) > 0 AND len(s.illegal) > 0) AS bad
  FROM up u JOIN af f ON f.request_id = u.request_id AND f.region = u.region JOIN sc s ON s.request_id = u.request_id AND s.region = u.region WHERE s.raw > 0),
afold AS (SELECT c.request_id, c.n, c.total, [{_AD.format(n="CAST(1 AS BIGINT)")}] AS kept FROM adc c WHERE c.n = 1
  UNION ALL
  SELECT f.request_id, c.n, f.total, CASE WHEN coalesce({_AGAIN}, 0) = 0 THEN list_append(f.kept, {_AD.format(n="CAST(len(f.kept) + 1 AS BIGINT)")})
      WHEN f.kept[{_AGAIN}].score < c.score THEN list_append(list_concat(f.kept[1:{_AGAIN} - 1], f.kept[{_AGAIN} + 1:]), {_AD.format(n="CAST(len(f.kept) + 1 AS BIGINT)")}) ELSE f.kept END
  FROM afold f JOIN adc c ON c.request_id = f.request_id AND c.n = f.n + 1),
ad AS MATERIALIZED (SELECT request_id, unnest(range(len(kept))) AS position, unnest(kept) AS a FROM afold WHERE n = total)"""
_LEVEL = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 45 THEN 'medium' ELSE 'low' END"
SQL["ad_dedup"] = f"""WITH RECURSIVE {ADS} SELECT request_id, CAST(position AS INT) AS position, CAST(a.ad_index AS INT) AS ad_index, a.score AS risk_score, {_LEVEL.format("a.score")} AS risk_level, a.bad AS suspicious,
  a.x1, a.y1, a.x2, a.y2, {_joined("a.ids")} AS block_indices, {_joined("a.rules")} AS hit_rules FROM ad"""

TOLD = rf"""{ADS},
da AS (SELECT request_id, count(*) AS n_ads, max(a.score) AS score, bool_or(a.bad) AS bad, flatten(list(a.words)) AS words, flatten(list(a.rules)) AS rules, flatten(list(a.ids)) AS inside FROM ad GROUP BY request_id),
db AS (SELECT request_id, count(*) AS n_blocks, flatten(list(phones)) AS phones, flatten(list(wechat_ids)) AS wechat_ids, flatten(list(qqs)) AS qqs, flatten(list(hit_keywords)) AS hit_keywords,
  flatten(list(hit_rules)) AS hit_rules, bool_or(noisy) AS noisy, bool_or(keyword) AS worded, bool_or(keyword OR contact) AS anchored, list(text ORDER BY block_index) AS texts,
  min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS millionths FROM bl GROUP BY request_id),
dd AS MATERIALIZED (SELECT db.request_id, n_blocks, CAST(coalesce(n_ads, 0) AS INT) AS n_ads, CAST(coalesce(score, 0) AS INT) AS risk_score, {_LEVEL.format("score")} AS risk_level, coalesce(bad, false) AS suspicious,
  CASE WHEN n_ads > 0 THEN '' WHEN NOT anchored THEN 'no_groups' WHEN len(phones) > 0 AND NOT worded THEN 'phone_only_without_business_keywords' WHEN noisy THEN 'noise_keywords' ELSE 'all_groups_filtered' END AS empty_reason,
  {", ".join(f"{_set(c)} AS {c}" for c in ("phones", "wechat_ids", "qqs"))}, {_set("list_concat(hit_keywords, coalesce(words, []))")} AS hit_keywords, {_set("list_concat(hit_rules, coalesce(rules, []))")} AS hit_rules,
  coalesce(inside, []) AS inside, texts, x1, y1, x2, y2, millionths FROM db LEFT JOIN da ON da.request_id = db.request_id)"""
SQL["spatial_evaluation"] = f"""WITH RECURSIVE {TOLD} SELECT request_id, n_blocks, n_ads, risk_score, risk_level, suspicious, empty_reason,
  {", ".join(f"{_joined(c)} AS {c}" for c in ("phones", "wechat_ids", "qqs", "hit_keywords", "hit_rules"))} FROM dd"""
# Cards ahead of the regions of the text.
_CARDED = f"""WHERE n = anchors),
{CARDS},
cr AS (SELECT n.request_id, n.card, struct_pack(anchor := CAST(NULL AS INT), members := list(n.block_index ORDER BY n.block_index), x1 := d.x1, y1 := d.y1, x2 := d.x2, y2 := d.y2) AS r
  FROM con n JOIN cd d ON d.request_id = n.request_id AND d.card = n.card GROUP BY n.request_id, n.card, d.x1, d.y1, d.x2, d.y2),
reg AS MATERIALIZED (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY source, place) - 1 AS region, r FROM (SELECT request_id, 0 AS source, card AS place, r FROM cr UNION ALL SELECT request_id, 1, region, r FROM reg0))"""
SQL["card_evaluation"] = (
    SQL["spatial_evaluation"].replace("reg AS MATERIALIZED (", "reg0 AS MATERIALIZED (", 1).replace("WHERE n = anchors)", _CARDED, 1).replace("NOT anchored THEN", "db.request_id NOT IN (SELECT request_id FROM reg) THEN")
)
_JSON = "'[' || coalesce(array_to_string(list_transform({}, lambda x: '\"' || x || '\"'), ','), '') || ']'"
SQL["diagnostic_report"] = f"""WITH RECURSIVE {TOLD}, tb AS (SELECT request_id, string_agg('{{"text":"' || text || '","matched":' || CASE WHEN len(hit_rules) > 0 THEN 'true' ELSE 'false' END || '}}', ',' ORDER BY block_index) AS b FROM bl WHERE block_index < 20 GROUP BY request_id)
SELECT dd.request_id, '{{"risk_score":' || risk_score || ',"suspicious":' || CASE WHEN suspicious THEN 'true' ELSE 'false' END || ',"hit_keywords":' || {_JSON.format("hit_keywords")} || ',"hit_rules":' || {_JSON.format("hit_rules")} || ',"ocr_blocks":[' || b || ']}}' AS report
FROM dd JOIN tb ON tb.request_id = dd.request_id"""
SQL["empty_reason"] = f"WITH RECURSIVE {TOLD} SELECT empty_reason, count(*) AS requests FROM dd GROUP BY empty_reason"
SQL["draw_commands"] = f"""WITH RECURSIVE {TOLD} SELECT b.request_id, b.block_index, CASE WHEN b.keyword THEN 'red' ELSE 'yellow' END AS colour, b.x1, b.y1, b.x2, b.y2
FROM bl b JOIN dd ON dd.request_id = b.request_id WHERE dd.suspicious AND (len(b.hit_rules) > 0 OR list_contains(dd.inside, b.block_index))"""

# Readings.
_SIMILAR = "(k.norm <> '' AND c.norm <> '' AND (contains(k.norm, c.norm) OR contains(c.norm, k.norm) OR (least(length(k.norm), length(c.norm)) >= 3 AND len(list_filter(range(1, least(length(k.norm), length(c.norm)) + 1), lambda i: k.norm[i] = c.norm[i])) / least(length(k.norm), length(c.norm)) >= 0.65)))"


def _close(limit: int) -> str:
    return f"(abs((k.x1 + k.x2) - (c.x1 + c.x2)) <= {limit} AND abs((k.y1 + k.y2) - (c.y1 + c.y2)) <= {limit})"


_SAME = f"(k.norm <> '' AND k.norm = c.norm AND ({_iou('c', 'k')} >= 0.25 OR {_close(24)})) OR ({_SIMILAR} AND ({_iou('c', 'k')} >= 0.5 OR {_close(24)}))"
_REPEAT = f"{_iou('c', 'k')} >= 0.45 OR {_close(30)}"
_READING = "struct_pack(i := c.i, norm := c.norm, confidence := c.confidence, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2)"


def _merge(name: str, new: str, start: str, repeats: str) -> str:
    """Rows of new (request_id, n, reading) folded into the lists of start (request_id, kept): name (request_id, n, kept)."""
    at = f"coalesce(list_position(list_transform(f.kept, lambda k: {repeats}), true), 0)"
    better = f"row(length(c.norm), c.confidence) > row(length(f.kept[{at}].norm), f.kept[{at}].confidence)"
    return f"""{name} AS (SELECT request_id, CAST(0 AS BIGINT) AS n, kept FROM {start} UNION ALL
  SELECT f.request_id, c.n, CASE WHEN {at} = 0 THEN list_append(f.kept, {_READING}) WHEN {better} THEN list_concat(f.kept[1:{at} - 1], [{_READING}], f.kept[{at} + 1:]) ELSE f.kept END
  FROM {name} f JOIN {new} c ON c.request_id = f.request_id AND c.n = f.n + 1)"""


def _last(name: str) -> str:
    return f"(SELECT request_id, arg_max(kept, n) AS kept FROM {name} GROUP BY request_id)"


_NONE = f"(SELECT request_id, list_filter(list({_READING}), lambda x: false) AS kept FROM rd c GROUP BY request_id)"
READINGS = rf"""{BOXES},
rd AS MATERIALIZED (SELECT request_id, block_index AS i, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS norm, confidence, x1, y1, x2, y2 FROM box)"""
_KEPT = "coalesce(array_to_string(list_transform(kept, lambda k: k.i), ','), '') AS kept"
SQL["ocr_dedup"] = f"""WITH RECURSIVE {READINGS}, nw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, i) AS n FROM rd), st AS {_NONE},
{_merge("fd", "nw", "st", _SAME)} SELECT request_id, {_KEPT} FROM {_last("fd")}"""
SQL["round_merge"] = f"""WITH RECURSIVE {READINGS}, nw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i) AS n FROM rd WHERE i % 2 = 1),
st AS (SELECT request_id, list({_READING} ORDER BY i) AS kept FROM rd c WHERE i % 2 = 0 GROUP BY request_id), {_merge("f1", "nw", "st", _REPEAT)},
md AS (SELECT request_id, unnest(kept) AS r, unnest(range(len(kept))) AS place FROM {_last("f1")}),
n2 AS MATERIALIZED (SELECT request_id, r.i AS i, r.norm AS norm, r.confidence AS confidence, r.x1 AS x1, r.y1 AS y1, r.x2 AS x2, r.y2 AS y2, row_number() OVER (PARTITION BY request_id ORDER BY r.confidence DESC, place) AS n FROM md),
s2 AS {_NONE}, {_merge("f2", "n2", "s2", _SAME)} SELECT request_id, {_KEPT} FROM {_last("f2")}"""
_CLUSTERS = f"""st AS MATERIALIZED (SELECT a.request_id, a.block_index AS a, b.block_index AS b FROM box a JOIN box b ON a.request_id = b.request_id
  AND abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) <= greatest(60, {_cut("greatest(20, a.x2 - a.x1) * 2.6::DOUBLE")}) AND abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= greatest(90, {_cut("greatest(20, a.y2 - a.y1) * 4.2::DOUBLE")})),
rc AS (SELECT * FROM st UNION SELECT r.request_id, r.a, s.b FROM rc r JOIN st s ON s.request_id = r.request_id AND s.a = r.b),
sd AS MATERIALIZED (SELECT request_id, a, list(b ORDER BY b) AS members FROM rc GROUP BY request_id, a),
cf AS (SELECT request_id, a, members AS used, [members] AS kept FROM sd WHERE a = 0 UNION ALL
  SELECT f.request_id, s.a, CASE WHEN list_contains(f.used, s.a) THEN f.used ELSE list_distinct(list_concat(f.used, s.members)) END, CASE WHEN list_contains(f.used, s.a) THEN f.kept ELSE list_append(f.kept, s.members) END
  FROM cf f JOIN sd s ON s.request_id = f.request_id AND s.a = f.a + 1),
cl AS MATERIALIZED (SELECT request_id, unnest(range(len(kept))) AS ordinal, unnest(kept) AS members FROM (SELECT request_id, arg_max(kept, a) AS kept FROM cf GROUP BY request_id))"""
SQL["box_clusters"] = f"WITH RECURSIVE {BOXES}, {_CLUSTERS} SELECT request_id, CAST(ordinal AS INT) AS cluster, {_joined('members')} AS members FROM cl"

# Planning. No box of the generator holds a line break.
_SOLID = r"[\x{4e00}-\x{9fff}A-Za-z0-9]"


def _count(test: str) -> str:
    return f"len(list_filter(texts, lambda x: {test}))"


FEATURES = rf"""{TOLD},
ft AS MATERIALIZED (SELECT *, array_to_string(texts, chr(10)) AS text, len(hit_keywords) AS words, len(phones) + len(wechat_ids) + len(qqs) > 0 AS contact, request_id % 3 = 0 AS card,
  list_sum(list_transform(texts, lambda x: length(regexp_replace(x, '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g')))) AS solid, list_sum(list_transform(texts, lambda x: length(trim(x)))) AS chars,
  {_count(f"regexp_matches(x, '{_SOLID}{{2,}}')")} AS meaningful, {_count("length(trim(x)) <= 2")} AS odd, {_count(f"length(trim(x)) <= 2 OR NOT regexp_matches(x, '{_SOLID}{{2,}}')")} AS scraps,
  {_count(rf"trim(x) <> '' AND NOT regexp_matches(x, '{_SOLID}')")} AS marks, {_count(r"regexp_matches(x, '\p{Nd}{7,}')")} > 0 AS digits,
  {_count(r"regexp_matches(x, '(?i)微信|vx|wechat|QQ|手机|电话|1[3-9][0-9]{5,}')")} > 0 AS partial_contact FROM dd),
fn AS (SELECT *, len({_hits((*NOISE, *NOISE_OF_READINGS))}) AS noise_words, len({_hits((*MEDICAL, *ILLEGAL))}) > 0 AS risk FROM ft),
fs AS MATERIALIZED (SELECT *, (contact AND words = 0 AND (noise_words > 0 OR scraps >= greatest(1, len(texts) // 2))) OR (len(hit_rules) > 0
  AND len(list_filter(hit_rules, lambda r: r NOT IN ('contact.phone', 'contact.wechat', 'contact.qq', 'fallback.phone_only'))) = 0) AS low FROM fn)"""
_KNOWN = """sh AS (SELECT *, len(list_filter(hit_keywords, lambda w: w IN ('医保', '医保卡', '统筹', '报销', '住院报销', '门诊统筹', '保取', '保提'))) AS med,
  len(list_filter(hit_keywords, lambda w: w IN ('套现', '取现', '提现', '回收', '高价回收'))) AS ill FROM fs)"""
_MEANING = f"""round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, least(3, med) * 18.0::DOUBLE + least(3, ill) * 16.0::DOUBLE + CASE WHEN len(phones) > 0 THEN 16 ELSE 0 END + CASE WHEN len(wechat_ids) > 0 THEN 14 ELSE 0 END
  + CASE WHEN len(qqs) > 0 THEN 10 ELSE 0 END + CASE WHEN med > 0 AND contact THEN 18 ELSE 0 END + least(12.0::DOUBLE, {_count("trim(x) <> ''")} * 2.5::DOUBLE) + least(8.0::DOUBLE, length(trim(replace(text, chr(10), ''))) / 10.0::DOUBLE)
  - noise_words * 16.0::DOUBLE - odd * 3.0::DOUBLE - CASE WHEN regexp_matches(text, '[?？]{{2,}}') THEN 8 ELSE 0 END)), 4)"""
SQL["semantic_score"] = f"WITH RECURSIVE {FEATURES}, {_KNOWN} SELECT request_id, {_MEANING} AS semantic_score, CAST(solid AS BIGINT) AS solid_length, low AS low_confidence FROM sh"
SQL["retry_gate"] = f"""WITH RECURSIVE {FEATURES} SELECT request_id, CASE WHEN risk_score >= 69 AND contact AND words >= 2 THEN '' WHEN words < 1 AND NOT contact AND NOT card THEN ''
  WHEN card AND words < 1 AND NOT contact AND solid <= 8 THEN 'card_candidate_low_text_recall' WHEN words >= 2 AND NOT contact THEN 'high_risk_keywords_missing_contact'
  WHEN len(texts) <= 5 AND chars <= 40 AND words >= 1 AND card THEN 'sparse_text_with_risk_words' WHEN risk_score BETWEEN 40 AND 69 AND words >= 1 AND card THEN 'mid_risk_with_card_region'
  WHEN contact AND card AND words < 1 AND low THEN 'contact_only_low_semantic' ELSE '' END AS reason FROM fs"""
SQL["best_variant"] = f"""WITH RECURSIVE {FEATURES}, v AS (SELECT request_id, list_concat(['normal'], CASE WHEN low AND contact AND words = 0 THEN ['mirrored'] ELSE [] END, CASE WHEN low AND contact THEN ['rotate_180'] ELSE [] END,
  CASE WHEN card AND solid <= 8 THEN ['rotate_180', 'rotate_90', 'rotate_270'] ELSE [] END, CASE WHEN (y2 - y1) / greatest(x2 - x1, 1) >= 1.45 AND low AND (contact OR partial_contact OR words <= 1) THEN ['rotate_90', 'rotate_270'] ELSE [] END,
  CASE WHEN request_id % 2 = 0 THEN ['perspective'] ELSE [] END, CASE WHEN card AND solid <= 8 THEN ['deskew', 'perspective'] ELSE [] END) AS steps FROM fs)
SELECT request_id, array_to_string(list_filter(steps, lambda x, i: list_position(steps, x) = i)[1:5], ',') AS variants FROM v"""
SQL["view_gates"] = f"""WITH RECURSIVE {FEATURES}, g AS (SELECT *, 600 + request_id % 1500 AS side, len(texts) AS boxes, CAST((2 * millionths + 100 * n_blocks) // (200 * n_blocks) AS DOUBLE) / 10000 AS confidence FROM fs)
SELECT request_id, boxes = 0 OR (solid <= 12 AND meaningful <= 6) OR (solid <= 18 AND NOT digits AND side >= 800) AS scan,
  boxes = 0 OR (NOT risk AND ((solid <= 24 AND meaningful <= 10) OR (digits AND noise_words > 0) OR (side >= 800 AND meaningful <= 12))) AS rotation,
  side >= 1800 AND (boxes = 0 OR (meaningful = 0 AND ((boxes <= 8 AND marks >= greatest(3, boxes - 1)) OR (confidence < 0.45 AND marks >= greatest(1, boxes // 2))))) AS tiles FROM g"""
_OUTLINES = """kc AS (SELECT *, CASE WHEN card = 1 THEN (x2 - x1) // 4 ELSE 0 END AS cut FROM cd),
kp AS (SELECT request_id, card AS region, unnest([x1 + cut, x2 - cut, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM kc)"""


def _padded(p, x: str = "w", y: str = "h") -> str:
    (a, b, c, d) = ((f"greatest({least}, {_cut(f'{side} * {share}::DOUBLE')})") for (least, share), side in zip(p, (x, x, y, y)))
    return f"x1 - {a} AS fx1, x2 + {b} AS fx2, y1 - {c} AS fy1, y2 + {d} AS fy2"


_NEARBY = f"""list(b.block_index ORDER BY b.block_index) FILTER (((b.x1 + b.x2) / 2 BETWEEN e.x1 AND e.x2 AND (b.y1 + b.y2) / 2 BETWEEN e.y1 AND e.y2) OR {_iou("e", "b")} >= 0.08)"""
FOCUS = rf"""{FEATURES}, {_CLUSTERS}, {CARDS}, {_OUTLINES}, {_rectangles("SELECT DISTINCT request_id, region, x, y FROM kp", "k")},
kx AS MATERIALIZED (SELECT c.*, degrees(atan(r.uy / r.ux)) AS angle,
    CASE WHEN abs((x2 - x1 - 2 * cut) - (x2 - x1)) / greatest(x2 - x1 - 2 * cut, x2 - x1, 1.0::DOUBLE) > 0.15 THEN 'trapezoid' ELSE 'rectangle' END AS shape
  FROM kc c JOIN krect r ON r.request_id = c.request_id AND r.region = c.card),
om AS (SELECT request_id, median((y1 + y2) / 2) AS middle FROM bl GROUP BY request_id),
ob AS MATERIALIZED (SELECT b.request_id, b.block_index FROM bl b JOIN om m ON m.request_id = b.request_id WHERE b.block_index % 3 = 2 AND length(regexp_replace(text, '\s', '', 'g')) <= 4 AND regexp_matches(text, '{_SOLID}')
  AND (y1 + y2) / 2 >= middle + greatest(40.0::DOUBLE, greatest(1, y2 - y1) * 0.6::DOUBLE) AND (regexp_matches(text, '[0-9]') OR greatest(greatest(1, x2 - x1), greatest(1, y2 - y1)) / least(greatest(1, x2 - x1), greatest(1, y2 - y1)) >= 1.15)),
ft2 AS MATERIALIZED (SELECT f.request_id, f.words, f.contact, f.low, f.solid <= 8 AS scant, EXISTS (SELECT 1 FROM kc c WHERE c.request_id = f.request_id) AS card, EXISTS (SELECT 1 FROM ob o WHERE o.request_id = f.request_id) AS oblique FROM fs f),
cb AS (SELECT c.request_id, 0 AS src, CAST(ordinal AS BIGINT) AS place, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2, any_value(c.members) AS members
  FROM (SELECT *, unnest(members) AS i FROM cl) c JOIN bl b ON b.request_id = c.request_id AND b.block_index = c.i GROUP BY c.request_id, ordinal),
raw AS (SELECT request_id, src, place, members, {_padded(((10, 0.08), (10, 0.08), (12, 0.10), (12, 0.10)))} FROM (SELECT *, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h FROM cb)
  UNION ALL SELECT request_id, 1, card, NULL, {_padded(_KINDS["card"])} FROM (SELECT c.*, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h FROM kc c JOIN ft2 f ON f.request_id = c.request_id WHERE NOT f.scant)
  UNION ALL SELECT request_id, 1, card, NULL, {_padded(_KINDS["wide"])} FROM (SELECT c.*, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h FROM kc c JOIN ft2 f ON f.request_id = c.request_id WHERE f.scant)
  UNION ALL SELECT request_id, 2, block_index, NULL, {_padded(_KINDS["box"])} FROM (SELECT b.*, greatest(1, x2 - x1) AS w, greatest(1, y2 - y1) AS h FROM bl b JOIN ob o ON o.request_id = b.request_id AND o.block_index = b.block_index)),
fr0 AS (SELECT *, least(greatest(0, fx1), 899) AS x1, least(greatest(0, fy1), 999) AS y1 FROM raw),
fr AS MATERIALIZED (SELECT request_id, src, place, members, x1, y1, least(greatest(x1 + 1, fx2), 900) AS x2, least(greatest(y1 + 1, fy2), 1000) AS y2, row_number() OVER (PARTITION BY request_id ORDER BY src, place) AS region FROM fr0),
fe AS (SELECT request_id, region, src, place, x1 - greatest(12, {_cut("(x2 - x1) * 0.14::DOUBLE")}) AS x1, y1 - greatest(12, {_cut("(y2 - y1) * 0.14::DOUBLE")}) AS y1, x2 + greatest(12, {_cut("(x2 - x1) * 0.14::DOUBLE")}) AS x2, y2 + greatest(12, {_cut("(y2 - y1) * 0.14::DOUBLE")}) AS y2 FROM fr WHERE src > 0),
nb AS (SELECT e.request_id, e.region, e.src, e.place, {_NEARBY} AS near FROM fe e JOIN bl b ON b.request_id = e.request_id GROUP BY e.request_id, e.region, e.src, e.place),
fm AS MATERIALIZED (SELECT r.* EXCLUDE (members), coalesce(CASE WHEN r.src = 0 THEN r.members WHEN r.src = 1 THEN n.near ELSE list_sort(list_distinct(list_append(coalesce(n.near, []), CAST(r.place AS INT)))) END, []) AS members
  FROM fr r LEFT JOIN nb n ON n.request_id = r.request_id AND n.region = r.region),
mb AS MATERIALIZED (SELECT m.request_id, m.region, b.* EXCLUDE (request_id), b.block_index IN (SELECT o.block_index FROM ob o WHERE o.request_id = b.request_id) AS scrap
  FROM (SELECT request_id, region, unnest(members) AS i FROM fm) m JOIN bl b ON b.request_id = m.request_id AND b.block_index = m.i),
{_rectangles("SELECT DISTINCT request_id, region, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM mb", "f")},
ms AS (SELECT request_id, region, string_agg(text, '' ORDER BY block_index) AS text, sum(greatest(1, (x2 - x1) * (y2 - y1))) AS text_area, sum(len(hit_keywords)) AS keywords,
    sum(CASE WHEN len(phones) > 0 THEN 1 ELSE 0 END + CASE WHEN len(wechat_ids) > 0 THEN 1 ELSE 0 END + CASE WHEN len(qqs) > 0 THEN 1 ELSE 0 END) AS contacts,
    sum(CASE WHEN regexp_matches(text, '\p{{Nd}}{{6,}}') THEN 1 ELSE 0 END) AS digits, count(*) AS boxes, sum(CASE WHEN scrap THEN 1 ELSE 0 END) AS oblique FROM mb GROUP BY request_id, region),
mn AS (SELECT *, len({_hits((*NOISE, *NOISE_OF_READINGS))}) > 0 AS noisy FROM ms),
kv AS (SELECT f.request_id, f.region, k.card, {_iou("f", "k")} AS overlap FROM fm f JOIN kx k ON k.request_id = f.request_id WHERE f.src <> 1),
ko AS (SELECT request_id, region, card, overlap FROM kv WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY request_id, region ORDER BY overlap DESC, card) = 1),
fc AS (SELECT f.*, CASE WHEN f.src = 1 THEN f.place ELSE o.card END AS card, coalesce(o.overlap, 0.0::DOUBLE) AS overlap FROM fm f LEFT JOIN ko o ON o.request_id = f.request_id AND o.region = f.region),
fg AS (SELECT c.request_id, c.region, c.src, c.place, c.members, c.x1, c.y1, c.x2, c.y2, c.card, c.overlap, k.angle AS card_angle, k.shape AS card_shape, greatest(1, (k.x2 - k.x1) * (k.y2 - k.y1)) AS card_area, greatest(1, (c.x2 - c.x1) * (c.y2 - c.y1)) AS region_area,
    CASE WHEN k.card IS NOT NULL THEN k.angle WHEN r.w IS NULL THEN 0.0::DOUBLE ELSE degrees(atan(r.uy / r.ux)) END AS angle,
    CASE WHEN k.card IS NOT NULL THEN k.shape WHEN r.w IS NULL OR least(r.w, r.h) <= 1 OR greatest(r.w, r.h) / greatest(1.0::DOUBLE, least(r.w, r.h)) > 4.5 THEN 'irregular' ELSE 'rectangle' END AS shape,
    coalesce(n.keywords, 0) AS keywords, coalesce(n.contacts, 0) AS contacts, coalesce(n.digits, 0) AS digits, coalesce(n.boxes, 0) AS boxes, coalesce(n.text_area, 0) AS text_area, coalesce(n.oblique, 0) AS scraps, coalesce(n.noisy, false) AS noisy,
    t.words, t.contact, t.low, t.scant, t.card AS has_card, t.oblique AS has_oblique
  FROM fc c LEFT JOIN kx k ON k.request_id = c.request_id AND k.card = c.card LEFT JOIN frect r ON r.request_id = c.request_id AND r.region = c.region LEFT JOIN mn n ON n.request_id = c.request_id AND n.region = c.region
  JOIN ft2 t ON t.request_id = c.request_id),
s1 AS (SELECT *, least(1.0::DOUBLE, keywords / 3.0::DOUBLE) * 0.34::DOUBLE + least(1.0::DOUBLE, (contacts + digits) / 3.0::DOUBLE) * 0.24::DOUBLE + least(1.0::DOUBLE, CAST(text_area AS DOUBLE) / region_area * 2.8::DOUBLE) * 0.14::DOUBLE
    + least(1.0::DOUBLE, boxes / 4.0::DOUBLE) * 0.12::DOUBLE + CASE shape WHEN 'rectangle' THEN 1.0 WHEN 'trapezoid' THEN 0.9 ELSE 0.55 END::DOUBLE * 0.16::DOUBLE + CASE WHEN src <> 1 AND overlap >= 0.2 THEN 0.18 ELSE 0.0 END::DOUBLE
    + CASE WHEN card IS NOT NULL THEN least(0.12::DOUBLE, CAST(card_area AS DOUBLE) / region_area * 0.04::DOUBLE) ELSE 0.0::DOUBLE END + CASE WHEN low AND src = 1 THEN 0.16 ELSE 0.0 END::DOUBLE
    - CASE WHEN low AND src = 0 AND keywords = 0 AND noisy THEN 0.18 ELSE 0.0 END::DOUBLE + CASE WHEN contact AND keywords = 0 AND src = 1 THEN 0.08 ELSE 0.0 END::DOUBLE AS s FROM fg),
s2 AS (SELECT *, CASE WHEN src = 1 AND scant AND card_area / 900000.0::DOUBLE >= 0.015 THEN greatest(s, 0.46::DOUBLE) ELSE s END + CASE WHEN src = 1 AND scant THEN 0.08 ELSE 0.0 END::DOUBLE + CASE WHEN src = 1 AND scant AND abs(angle) >= 8 THEN 0.06 ELSE 0.0 END::DOUBLE
    + CASE WHEN scraps > 0 AND src = 2 THEN 0.32 ELSE 0.0 END::DOUBLE + CASE WHEN scraps > 0 AND src <> 2 AND keywords = 0 AND contacts = 0 THEN least(0.18::DOUBLE, scraps * 0.12::DOUBLE) ELSE 0.0::DOUBLE END AS t FROM s1),
s3 AS (SELECT *, CAST(printf('%.4f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, t))) AS DOUBLE) AS score FROM s2 WHERE x2 - x1 >= 48 AND y2 - y1 >= 48 AND NOT (src = 0 AND words > 0 AND keywords = 0 AND digits = 0)),
fx AS MATERIALIZED (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, src, place) = 1
  AND score >= least(CASE WHEN has_card AND scant THEN 0.32 ELSE 0.55 END, CASE WHEN has_oblique AND words = 0 AND NOT contact THEN 0.4 ELSE 0.55 END))"""
SQL["focus_regions"] = f"""WITH RECURSIVE {FOCUS} SELECT request_id, ['text_cluster', 'card_candidate', 'oblique_small_text'][src + 1] AS source, CAST(place AS INT) AS place, score, x1, y1, x2, y2, shape, round(angle, 6) AS angle, CAST(card AS INT) AS card, {_joined("members")} AS members FROM fx"""


def _carded(sql: str) -> str:
    """The same with cards ahead of the regions of the text."""
    out = sql.replace("reg AS MATERIALIZED (", "reg0 AS MATERIALIZED (", 1).replace("WHERE n = anchors)", _CARDED, 1)
    return out.replace("NOT anchored THEN", "db.request_id NOT IN (SELECT request_id FROM reg) THEN")


# A first reading of every other box, looked at again: the first evaluation is a query of its own, the merged readings of each
# view are the boxes of the second one, under request_id * 10 + view.
_HALF = "\nbox AS (SELECT * REPLACE (CAST(block_index // 2 AS INT) AS block_index) FROM box0 WHERE block_index % 2 = 0)"
_BOX0 = BOXES.replace("box AS (", "box0 AS (", 1)
_FIRST = _carded(FOCUS.replace(f"{CARDS}, {_OUTLINES}", _OUTLINES)).replace(BOXES, f"{_BOX0},{_HALF}", 1)
_VARIANTS = """list_concat(['normal'], CASE WHEN low AND contact AND words = 0 THEN ['mirrored'] ELSE [] END, CASE WHEN low AND contact AND shape <> 'irregular' THEN ['rotate_180'] ELSE [] END,
  CASE WHEN src = 1 AND scant THEN ['rotate_180', 'rotate_90', 'rotate_270'] ELSE [] END, CASE WHEN oblique AND words = 0 AND NOT contact THEN ['deskew', 'rotate_90', 'rotate_270'] ELSE [] END,
  CASE WHEN (y2 - y1) / greatest(x2 - x1, 1) >= 1.45 AND shape <> 'irregular' AND low AND (contact OR partial_contact OR words <= 1) THEN ['rotate_90', 'rotate_270'] ELSE [] END,
  CASE WHEN shape = 'trapezoid' THEN ['perspective'] WHEN abs(angle) BETWEEN 8 AND 20 THEN ['deskew'] ELSE [] END, CASE WHEN src = 1 AND scant THEN ['deskew', 'perspective'] ELSE [] END)"""
_PLAN = f"""one AS MATERIALIZED (WITH RECURSIVE {_FIRST}, {_KNOWN}, sm AS (SELECT *, {_MEANING} AS score FROM sh),
rr AS (SELECT h.*, x.src, x.shape, x.angle AS turn, q.cut <= q.y2 - q.y1 AS straight, x.x1 AS fx1, x.y1 AS fy1, x.x2 AS fx2, x.y2 AS fy2, t.scant, t.oblique, t.card AS carded, CASE WHEN risk_score >= 69 AND h.contact AND h.words >= 2 THEN ''
    WHEN h.words < 1 AND NOT h.contact AND NOT t.card AND NOT t.oblique THEN '' WHEN t.card AND h.words < 1 AND NOT h.contact AND t.scant THEN 'card_candidate_low_text_recall' WHEN h.words >= 2 AND NOT h.contact THEN 'high_risk_keywords_missing_contact'
    WHEN t.oblique AND h.words < 1 AND NOT h.contact THEN 'oblique_small_text' WHEN len(texts) <= 5 AND chars <= 40 AND h.words >= 1 AND t.card THEN 'sparse_text_with_risk_words' WHEN risk_score BETWEEN 40 AND 69 AND h.words >= 1 AND t.card THEN 'mid_risk_with_card_region'
    WHEN h.contact AND t.card AND h.words < 1 AND h.low THEN 'contact_only_low_semantic' ELSE '' END AS reason FROM sm h JOIN ft2 t ON t.request_id = h.request_id LEFT JOIN fx x ON x.request_id = h.request_id
  LEFT JOIN kc q ON q.request_id = x.request_id AND q.card = x.card),
rv AS (SELECT *, CASE WHEN reason <> '' AND src IS NOT NULL THEN {_VARIANTS.replace("angle", "turn").replace("y2", "fy2").replace("y1", "fy1").replace("x2", "fx2").replace("x1", "fx1")} ELSE [] END AS steps FROM rr),
rw2 AS (SELECT *, list_filter(steps, lambda s, i: list_position(steps, s) = i)[1:5] AS five FROM rv)
SELECT request_id, reason, score, hit_keywords, list_filter(five, lambda s: s <> 'perspective' OR coalesce(straight, false)) AS variants, (SELECT list(struct_pack(card := c.card, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2) ORDER BY c.card) FROM cd c WHERE c.request_id = rw2.request_id) AS cards FROM rw2)"""
_TRIES = rf"""{_BOX0},
vs AS MATERIALIZED (SELECT request_id * 10 + k AS request_id, request_id AS id, k, variants[k + 1] AS variant FROM (SELECT request_id, variants, unnest(range(len(variants))) AS k FROM one)),
rd0 AS MATERIALIZED (SELECT request_id AS id, block_index, CASE WHEN block_index % 2 = 0 THEN block_index // 2 ELSE 1000 END AS place, text, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS norm, confidence, x1, y1, x2, y2 FROM box0),
lk AS MATERIALIZED (SELECT v.request_id, 1000 + b.block_index AS i, norm, CASE WHEN b.block_index % 4 = 0 THEN confidence + 1.0::DOUBLE ELSE confidence END AS confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY v.request_id ORDER BY b.block_index) AS n
  FROM vs v JOIN rd0 b ON b.id = v.id AND (b.block_index % 2 = 1 OR b.block_index % 4 = 0) AND (b.block_index + v.k) % 3 <> 0),
fr1 AS (SELECT v.request_id, CAST(c.block_index AS BIGINT) AS i, c.norm, c.confidence, c.x1, c.y1, c.x2, c.y2, c.place FROM vs v JOIN rd0 c ON c.id = v.id AND c.block_index % 2 = 0),
st1 AS (SELECT request_id, list({_READING} ORDER BY c.place) AS kept FROM fr1 c GROUP BY request_id), {_merge("mf1", "lk", "st1", _REPEAT)},
md1 AS (SELECT request_id, unnest(kept) AS r, unnest(range(len(kept))) AS place FROM {_last("mf1")}),
md2 AS MATERIALIZED (SELECT request_id, r.i AS i, r.norm AS norm, r.confidence AS confidence, r.x1 AS x1, r.y1 AS y1, r.x2 AS x2, r.y2 AS y2, row_number() OVER (PARTITION BY request_id ORDER BY r.confidence DESC, place) AS n FROM md1),
st2 AS (SELECT request_id, list_filter(list({_READING}), lambda x: false) AS kept FROM md2 c GROUP BY request_id), {_merge("mf2", "md2", "st2", _SAME)},
mg AS MATERIALIZED (SELECT request_id, unnest(kept) AS r, unnest(range(len(kept))) AS place FROM {_last("mf2")}),
mk AS MATERIALIZED (SELECT g.request_id, v.id, g.r.i % 1000 AS block_index, g.place, g.r.confidence AS confidence FROM mg g JOIN vs v ON v.request_id = g.request_id),
box AS MATERIALIZED (SELECT k.request_id, CAST(k.place AS INT) AS block_index, b.text, b.x1, b.y1, b.x2, b.y2, k.confidence FROM mk k JOIN rd0 b ON b.id = k.id AND b.block_index = k.block_index)"""
_CARDS_OF_TRIES = "cd AS (SELECT v.request_id, c.card, c.x1, c.y1, c.x2, c.y2 FROM (SELECT request_id AS id, unnest(cards) AS c FROM one) o JOIN vs v ON v.id = o.id),\ncwide AS"
_SECOND = _carded(FEATURES).replace(CARDS[: CARDS.index("cwide AS") + len("cwide AS")], _CARDS_OF_TRIES, 1).replace(BOXES, f"{_PLAN},{_TRIES}", 1)
SQL["retry_run"] = f"""WITH RECURSIVE {_SECOND}, {_KNOWN},
lc AS (SELECT request_id, CAST((2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10000 AS confidence FROM lk GROUP BY request_id),
sm AS (SELECT *, {_MEANING} AS score FROM sh),
tr AS (SELECT v.id, v.k, v.variant, h.score, h.hit_keywords, n_blocks, coalesce(l.confidence, 0.0) AS confidence, h.request_id FROM sm h JOIN vs v ON v.request_id = h.request_id LEFT JOIN lc l ON l.request_id = h.request_id),
bs AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, confidence DESC, n_blocks DESC, k) = 1),
ch AS MATERIALIZED (SELECT o.request_id, o.reason, o.score AS first_score, b.variant, b.score AS retry_score, coalesce(b.score > o.score OR b.hit_keywords <> o.hit_keywords, false) AS selected, b.request_id AS key FROM one o LEFT JOIN bs b ON b.id = o.request_id),
fb AS (SELECT c.request_id, b.text, b.x1, b.y1, b.confidence, CAST(b.block_index AS BIGINT) AS place FROM ch c JOIN box b ON b.request_id = c.key WHERE c.selected
  UNION ALL SELECT c.request_id, b.text, b.x1, b.y1, b.confidence, b.place FROM ch c JOIN rd0 b ON b.id = c.request_id AND b.block_index % 2 = 0 WHERE NOT c.selected),
fa AS (SELECT request_id, string_agg(text, '|' ORDER BY y1, x1, place) AS ocr_text, count(*) AS n, CAST((2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10000 AS confidence FROM fb GROUP BY request_id),
n1 AS (SELECT id, count(*) AS n FROM rd0 WHERE block_index % 2 = 0 GROUP BY id)
SELECT c.request_id, reason, first_score, variant, retry_score, selected, CAST(greatest(0, a.n - n1.n) AS INT) AS added, a.confidence, ocr_text FROM ch c JOIN fa a ON a.request_id = c.request_id JOIN n1 ON n1.id = c.request_id"""

# The map from an upright rectangle of w x h to four corners in closed form, where the engine solves eight equations.
SQL["view_maps"] = """WITH d AS (SELECT p_partkey, 2 + p_partkey % 7 AS s, 1 + p_partkey % 5 AS t, [4, 12, 5, 3, 1, -4][p_partkey % 6 + 1] AS dx, [3, 5, 12, -4, 0, 3][p_partkey % 6 + 1] AS dy, 100 + p_partkey % 300 AS x0, 100 + p_partkey % 200 AS y0 FROM part),
q AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS i, unnest([x0, x0 + dx * s, x0 + dx * s - dy * t + p_partkey % 11, x0 - dy * t]) AS x, unnest([y0, y0 + dy * s + p_partkey % 7, y0 + dy * s + dx * t, y0 + dx * t]) AS y FROM d),
o AS (SELECT p_partkey, arg_min([x, y], (x + y) * 10 + i) AS a, arg_min([x, y], (y - x) * 10 + i) AS b, arg_max([x, y], (x + y) * 10 - i) AS c, arg_max([x, y], (y - x) * 10 - i) AS e FROM q GROUP BY p_partkey),
z AS (SELECT p_partkey, CAST(a[1] AS DOUBLE) AS ua, CAST(a[2] AS DOUBLE) AS va, CAST(b[1] AS DOUBLE) AS ub, CAST(b[2] AS DOUBLE) AS vb, CAST(c[1] AS DOUBLE) AS uc, CAST(c[2] AS DOUBLE) AS vc, CAST(e[1] AS DOUBLE) AS ue, CAST(e[2] AS DOUBLE) AS ve FROM o),
g AS (SELECT *, CAST(greatest(32, floor(greatest(sqrt((ub - ua) ** 2 + (vb - va) ** 2), sqrt((uc - ue) ** 2 + (vc - ve) ** 2)))) AS INT) AS w, CAST(greatest(32, floor(greatest(sqrt((ue - ua) ** 2 + (ve - va) ** 2), sqrt((uc - ub) ** 2 + (vc - vb) ** 2)))) AS INT) AS h,
  ua - ub + uc - ue AS sx, va - vb + vc - ve AS sy, (ub - uc) * (ve - vc) - (ue - uc) * (vb - vc) AS det FROM z
  WHERE ((ub - ua) * (vc - va) - (vb - va) * (uc - ua)) <> 0 AND ((ub - ua) * (ve - va) - (vb - va) * (ue - ua)) <> 0 AND ((uc - ua) * (ve - va) - (vc - va) * (ue - ua)) <> 0 AND ((uc - ub) * (ve - vb) - (vc - vb) * (ue - ub)) <> 0),
k AS (SELECT *, (sx * (ve - vc) - (ue - uc) * sy) / det AS gg, ((ub - uc) * sy - sx * (vb - vc)) / det AS hh FROM g),
m AS (SELECT p_partkey, w, h, [(ub - ua + gg * ub) / (w - 1), (ue - ua + hh * ue) / (h - 1), ua, (vb - va + gg * vb) / (w - 1), (ve - va + hh * ve) / (h - 1), va, gg / (w - 1), hh / (h - 1), 1.0] AS m FROM k),
p AS (SELECT p_partkey, CAST(300 + p_partkey % 500 AS INT) AS w, CAST(200 + p_partkey % 700 AS INT) AS h FROM part)
SELECT p_partkey, 'pre_card_0' AS name, 1.8::DOUBLE AS scale, 0 AS quadrants, w AS crop_width, h AS crop_height, array_to_string(list_transform(m, lambda v: printf('%.4f', v + 1.2345678e-5::DOUBLE)), ' ') AS matrix, CAST(NULL AS INT) AS x, CAST(NULL AS INT) AS y FROM m
UNION ALL SELECT p_partkey, 'full_rotate_90', 1.0, 1, w, h, '', 27, h - 18 FROM p UNION ALL SELECT p_partkey, 'full_rotate_180', 1.0, 2, w, h, '', w - 18, h - 27 FROM p UNION ALL SELECT p_partkey, 'full_rotate_270', 1.0, 3, w, h, '', w - 27, 18 FROM p"""

_STARTS = "list_sort(list_distinct([{}]))"
SQL["ocr_views"] = f"""WITH p AS (SELECT p_partkey, CAST(300 + (p_partkey * 37) % 2200 AS INT) AS w, CAST(300 + (p_partkey * 53) % 2400 AS INT) AS h FROM part),
s AS (SELECT *, least(w, greatest({_cut("w * 0.62::DOUBLE")}, w // 2)) AS tw, least(h, greatest({_cut("h * 0.62::DOUBLE")}, h // 2)) AS th,
  least(w, greatest({_cut("w * 0.68::DOUBLE")}, least(w, 420))) AS cw, least(h, greatest({_cut("h * 0.68::DOUBLE")}, least(h, 420))) AS ch FROM p),
t AS (SELECT *, {_STARTS.format("0, w - tw")} AS tx, {_STARTS.format("0, h - th")} AS ty, {_STARTS.format("0, (w - cw) // 2, w - cw")} AS sx, {_STARTS.format("0, (h - ch) // 2, h - ch")} AS sy FROM s),
v AS (SELECT p_partkey, 'initial' AS kind, 'full' AS name, 0 AS place, 0 AS x1, 0 AS y1, w AS x2, h AS y2 FROM t
  UNION ALL SELECT p_partkey, 'initial', 'top_crop', 1, 0, 0, w, {_cut("h * 0.82::DOUBLE")} FROM t WHERE h > w * 1.15::DOUBLE
  UNION ALL SELECT p_partkey, 'tile', concat('tile_', r.r, '_', c.c), 0, tx[c.c + 1], ty[r.r + 1], tx[c.c + 1] + tw, ty[r.r + 1] + th FROM t, range(3) r(r), range(3) c(c) WHERE r.r < len(ty) AND c.c < len(tx) AND greatest(w, h) >= 1800 AND tw < w AND th < h
  UNION ALL SELECT p_partkey, 'tile', 'bottom_crop', 0, 0, greatest(0, h - {_cut("h * 0.72::DOUBLE")}), w, h FROM t WHERE h > w * 1.05::DOUBLE AND greatest(w, h) >= 1800 AND tw < w AND th < h
  UNION ALL SELECT p_partkey, 'scan', concat('scan_', r.r, '_', c.c), r.r * len(sx) + c.c, sx[c.c + 1], sy[r.r + 1], sx[c.c + 1] + cw, sy[r.r + 1] + ch FROM t, range(3) r(r), range(3) c(c) WHERE r.r < len(sy) AND c.c < len(sx)
  UNION ALL SELECT p_partkey, 'scan', 'scan_lower', len(sx) * len(sy), 0, greatest(0, h - {_cut("h * 0.62::DOUBLE")}), w, h FROM t WHERE h > w)
SELECT p_partkey, kind, name, x1, y1, x2, y2 FROM v WHERE place < 7"""

_POLYGON = "array_to_string(list_transform({}, lambda p: CAST(p[1] AS VARCHAR) || ' ' || CAST(p[2] AS VARCHAR)), ',')"
SQL["ad_polygons"] = f"""WITH RECURSIVE {ADS} SELECT request_id, CAST(position AS INT) AS position, {_POLYGON.format("a.poly")} AS points, concat('医保广告 ', upper({_LEVEL.format("a.score")}), ' ', a.score) AS label,
  greatest(12, a.x1) AS label_x, greatest(12, a.y1 - 44) AS label_y FROM ad WHERE request_id IN (SELECT request_id FROM ad WHERE a.bad)"""
_TURNED = """tp AS (SELECT p_partkey, p_partkey // 5 AS request_id, CAST(p_partkey % 5 AS INT) AS region, 2 + p_partkey % 7 AS s, 1 + p_partkey % 5 AS t, [4, 12, 5, 3, 1, -4][p_partkey % 6 + 1] AS dx, [3, 5, 12, -4, 0, 3][p_partkey % 6 + 1] AS dy,
  100 + p_partkey % 300 AS x0, 100 + p_partkey % 200 AS y0 FROM part),
tc AS (SELECT request_id, region AS box, unnest([x0, x0 + dx * s, x0 + dx * s - dy * t, x0 - dy * t]) AS x, unnest([y0, y0 + dy * s, y0 + dy * s + dx * t, y0 + dx * t]) AS y FROM tp)"""
SQL["refined_regions"] = f"""WITH {_TURNED}, {_rectangles("SELECT DISTINCT request_id, 0 AS region, x, y FROM tc")}
SELECT request_id, round(degrees(atan(uy / ux)), 6) AS angle, round(w, 6) AS width, round(h, 6) AS height, {_POLYGON.format(_corners("greatest(w, 24) * 1.55::DOUBLE", "greatest(h, 24) * 1.8::DOUBLE"))} AS points,
  {_POLYGON.format("list_transform(" + _corners("greatest(w, 24) * 1.55::DOUBLE", "greatest(h, 24) * 1.8::DOUBLE") + ", lambda p: [least(greatest(0, p[1]), 399), least(greatest(0, p[2]), 299)])")} AS clipped,
  CASE WHEN least(w, h) <= 1 OR greatest(w, h) / greatest(1.0::DOUBLE, least(w, h)) > 4.5 THEN 'irregular' ELSE 'rectangle' END AS shape FROM rect"""
SQL["nested_results"] = SQL["recognised_boxes"]
SQL["semantic_entities"] = f"""WITH RECURSIVE {FEATURES} SELECT request_id, {_joined(_hits((*NOISE, *NOISE_OF_READINGS)))} AS noise_hits, CAST(odd AS INT) AS odd_blocks, CAST(len(texts) AS INT) AS block_count FROM fn"""
SQL["annotation_sizes"] = """WITH p AS (SELECT p_partkey, CAST(300 + (p_partkey * 37) % 2200 AS INT) AS w, CAST(300 + (p_partkey * 53) % 2400 AS INT) AS h FROM part), l AS (SELECT *, greatest(w, h) AS m, greatest(4, least(8, greatest(w, h) // 180)) AS line FROM p)
SELECT p_partkey, line AS line_width, line + 1 AS ad_line_width, greatest(20, least(42, m // 28)) AS font_size, CASE WHEN m > 1800 THEN CAST(trunc(w * (1800.0::DOUBLE / m)) AS INT) ELSE w END AS kept_width, CASE WHEN m > 1800 THEN CAST(trunc(h * (1800.0::DOUBLE / m)) AS INT) ELSE h END AS kept_height FROM l"""
SQL["encoded_files"] = "SELECT page_id, md5(base64(encode(CASE WHEN page_id % 10 <> 0 THEN html END))) AS encoded_md5 FROM pages"
SQL["normalized_texts"] = rf"WITH {TEXTS}, n AS (SELECT kind, id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS t FROM t) SELECT kind, id, CAST(length(t) AS INT) AS length, md5(t) AS digest FROM n"
SQL["turn_noise"] = rf"""WITH c AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '\S'))) AS text FROM conversations),
w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM c)
SELECT conv_id, turn, count(*) AS words, count(*) FILTER (trim(word, ' ' || chr(9) || chr(11) || chr(12)) <> '' AND NOT regexp_matches(word, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]')) AS noise_words FROM w GROUP BY conv_id, turn"""
SQL["similar_part_names"] = r"""WITH n AS (SELECT p_brand, p_type, regexp_replace(lower(concat(p_name, ' no ', p_partkey % 50)), '[^\p{L}\p{N}]', '', 'g') AS t, count(*) AS n FROM part GROUP BY ALL),
p AS (SELECT a.p_brand, a.p_type, a.t AS a, b.t AS b, a.n AS a_parts, b.n AS b_parts, CASE WHEN length(a.t) <= length(b.t) THEN a.t ELSE b.t END AS s, CASE WHEN length(a.t) <= length(b.t) THEN b.t ELSE a.t END AS l
  FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.t < b.t)
SELECT p_brand, p_type, a AS a_name, b AS b_name, a_parts, b_parts FROM p WHERE contains(a, b) OR contains(b, a) OR (length(s) >= 3 AND len(list_filter(range(1, length(s) + 1), lambda i: s[i] = l[i])) / length(s) >= 0.65)"""
