"""Repeated and hot rows, clashing names, long items, and methods held to what they promise."""

import collections
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import SF
from pyspark.sql import functions as F

from boxsift.llm import common, decontamination, language_id, mixing, ngram_join, quality_classifier, quality_rules, secrets, shingles, token_output, url_filter, warc
from boxsift.llm.common import shared_dir, token_file


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(f"v{x}" for x in rng.integers(0, 3000, n))


# Shared


def test_shared_dir_needs_a_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session(), "t")
    Context.master = "local[2]"
    assert common.shared_dir(Session(), "t") != common.shared_dir(Session(), "t")


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w" * int(k) + str(k).encode() for k in rng.integers(1, 60, 200)) for _ in range(5)] + [b"", b"x" * 5000, b" \n"]
    h, owner = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    monkeypatch.setattr(shingles, "_POWERS", {})
    g, of = shingles.word_hashes(texts)
    assert (h == g).all() and (owner == of).all()


# 2


def test_mixing_draws_repeated_rows_one_by_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a")] * 400 + [(None, text, "b")] * 200 + [(k, prose(np.random.default_rng(k), 3 + k % 90), "c") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(7)).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 100 for s, t in target.items()) and all(abs(taken[s] - target[s]) <= 10 for s in "ab")
    again = mixing.mix(df.repartition(3)).collect()
    plain = lambda rows: sorted(map(str, rows))
    assert plain(got) == plain(again)
    assert mixing.mixed_rows(df).count() == sum(r["copies"] for r in got)


def test_mixing_odds_are_unequal(spark):
    """Inclusion grows with the measure, and a document's mean number of copies over many seeds is what is expected of it."""
    rows = [(k, " ".join(["w"] * (1 if k % 2 else 60)), "a" if k < 400 else "b") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, expected = collections.Counter(), {}
    for seed in range(4):
        for r in mixing.mix(df, seed=seed).where("source = 'b'").collect():
            total[r["size"]] += r["copies"] / (4 * 400)
            expected[r["size"]] = r["expected"]
    assert 0 < expected[1] < expected[60] < 1
    assert all(abs(total[s] - e) < 0.05 for s, e in expected.items())


# 3, 1, 5: names that operators use themselves


def test_clashing_names(spark, odd_docs):
    names = ("gone_id", "twice_id", "leaked_id", "_words", "_t", "_lines", "join_id", "leaked_x", "_rule_kept", "n_words", "a.b")
    df = odd_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for out in (ngram_join.one_of_each(df), decontamination.clean(df, bench), quality_rules.kept_rows(df), mixing.mixed_rows(df)):
        assert out.columns == df.columns and {r["_words"] for r in out.collect()} == {3}
    judged = quality_rules.apply_rules(df.drop("n_words")).first()
    assert judged["_words"] == 3 and judged["_lines"] == 5


def test_given_rules_count(spark):
    text = " ".join(f"the w{k}" for k in range(40)) + " a b c a b c"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    strict = quality_rules.apply_rules(df, rules=(quality_rules.Rule("repeated_windows", "repeat_ratio", high=0.01),)).first()
    assert strict["failed_rules"] == ["repeated_windows"] and quality_rules.apply_rules(df).first()["kept"]


def test_join_of_a_template(spark):
    """A third of all documents share most of their words, in several groups that do not link."""
    rng = np.random.default_rng(5)
    common_words = [f"t{k}" for k in range(30)]
    rows = []
    for i in range(90):
        own = [f"g{i % 6}x{k}" for k in range(30)]
        w = common_words + own if i % 3 == 0 else prose(rng, 60).split()
        if i % 3 == 0 and i % 2:
            w[40] = f"z{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 3, 80).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in sets}


# 1


PARAPHRASES = {
    "swapped": lambda w, new: [x for k in range(0, len(w), 4) for x in (w[k : k + 2][::-1] + w[k + 2 : k + 4])],
    "a quarter replaced": lambda w, new: [new() if k % 4 == 1 else x for k, x in enumerate(w)],
    "two fifths replaced": lambda w, new: [new() if k % 5 in (1, 3) else x for k, x in enumerate(w)],
    "halves exchanged": lambda w, new: w[len(w) // 2 :] + w[: len(w) // 2],
}


def test_paraphrases_of_each_kind(spark):
    rng = np.random.default_rng(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hosts = [w for w in (words(r["text"]) for r in docs.orderBy("doc_id").collect()) if len(w) > 60]
    pool = [x for w in hosts[:50] for x in w]
    rows, planted = [], collections.defaultdict(set)
    for r in bench.orderBy("item_id").collect():
        for kind, f in PARAPHRASES.items():
            host = hosts[rng.integers(len(hosts))]
            at = rng.integers(len(host))
            rows.append((-1 - len(rows), " ".join(host[:at] + f(words(r["text"]), lambda: pool[rng.integers(len(pool))]) + host[at:])))
            planted[kind].add((rows[-1][0], r["item_id"]))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs.union(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    for kind, pairs in planted.items():
        assert len(pairs & found) >= 0.9 * len(pairs), kind
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r["item_id"]: flat(r["text"]) for r in bench.collect()}
    texts = {r["doc_id"]: flat(r["text"]) for r in docs.collect()}
    assert all(items[i] in texts[d] for d, i in found if d >= 0)  # nothing is found in documents that do not have it


def test_long_items_and_given_answers(spark):
    rng = np.random.default_rng(9)
    item = prose(rng, 3000)
    w = item.split()
    question = " ".join(f"q{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item, None), (2, f"{question}. Read with care.", "seven red lanterns")], "item_id long, text string, answer string")
    kept = [x for k, x in enumerate(question.split()) if k % 2]
    rows = [(1, f"{prose(rng, 200)} {' '.join(w[1000:1700])} {prose(rng, 200)}"), (2, prose(rng, 2000)), (3, f"{prose(rng, 50)} {' '.join(kept)} Read with seven red lanterns {prose(rng, 50)}")]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(1, 1), (3, 2)}


# 4


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    letters = {f"l{k}": [chr(97 + (k * 5 + j) % 26) for j in range(4)] for k in range(5)}
    rows = [(i, " ".join("".join(rng.choice(letters[lang], 4)) for _ in range(20)), lang) for i, lang in enumerate(list(letters) * 60)]
    rows += [(-1, "aaaa bbbb", "l0")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=40)
    got = language_id.predict(df.where("doc_id >= 0"), model, keep=("doc_id", "lang", ))
    assert got.where("lang = lang_pred").count() >= 0.95 * 300
    clash = df.withColumn("score", F.lit("x"))
    assert language_id.predict(clash, model, keep=("doc_id", "score")).columns == ["doc_id", "lang_pred", "score", "rejected"]


# 6


def test_random_strings(spark):
    secret = ["Zx9Kq2Lw8Rt5Yp1Vb7Nm3Qs6Hd4Jf0", "pQ7zR2mK9xV4tB8nL5wY1cH6jD3gF0s", "8fK2mPq9Zr4Xv7Lw1Nt6Yb3Hc5Jd0Gs"]
    plain = ["internationalization", "https://example.com/a/very/long/path/of/words", "Donaudampfschiffahrtsgesellschaft", "snake_case_identifier_name"]
    df = spark.createDataFrame(list(enumerate([*secret, *plain])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_random"] for r in secrets.digest(secrets.scan(df, token_file("byte_bpe_50k.tiktoken"))).collect()}
    assert [got[k] for k in range(3)] == [1, 1, 1] and not any(got[k] for k in range(3, 7))


# 7


def test_token_files(spark):
    """Encodings and page indexes of what is written, as a Parquet reader sees them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_dir(spark, "tokens")
    token_output.write_tokens(docs, path, token_file("word_bpe_49k.json"), 2, by_word=True)
    files = [f for f in docs.sparkSession.read.parquet(f"{path}/tokens").inputFiles()]
    for f in files:
        group = pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


# 8


def test_views_pass_labels_to_each_other(spark):
    """Where source tells quality, documents without labels teach both views, and words that only they have are learned."""
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(1200):
        good = i % 2 == 0
        kind = "g" if good else "b"
        late = i >= 300
        vocabulary = [f"{zlib.crc32(f'{kind}{x}'.encode()):x}" for x in (rng.integers(40, 80, 30) if late and i % 3 else rng.integers(0, 40, 30))]
        rows.append((i, " ".join(vocabulary), f"src{'A' if good else 'B'}{i % 3}", "en", 100))
        if not late:
            marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    first, last = model.passed[0], model.passed[-1]
    assert len(model.passed) == quality_classifier.ROUNDS and first["meta_to_text"] == last["meta_to_text"] == 900
    assert 300 <= first["text_to_meta"] < last["text_to_meta"] == 900  # the words that the other view has taught
    alone = quality_classifier.train(docs, labels, rounds=0)
    late = docs.where("doc_id >= 300 AND doc_id % 3 > 0").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})

    def spread(m):
        got = quality_classifier.score(late, m).groupBy((F.col("doc_id") % 2).alias("bad")).agg(F.avg("text_score").alias("s")).collect()
        by = {r["bad"]: r["s"] for r in got}
        return by[0] - by[1]

    assert spread(model) > 0.8 > spread(alone) + 0.2


def test_views_pass_labels_in_the_given_tables(spark):
    """Both views teach in every round, though the metadata says next to nothing of quality there, and no accuracy is lost by it."""
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality_classifier.train(read("documents"), read("labels").where(~held))
    assert len(model.passed) == quality_classifier.ROUNDS and all(min(p.values()) > 0 for p in model.passed)
    big = spark.createDataFrame([(2**60 + 1, "plain words of prose", "a", "en", 20), (2**60, "plain words of prose", "a", "en", 20)], "doc_id long, text string, source string, lang string, n_chars long")
    marks = spark.createDataFrame([(2**60, 1)], "doc_id long, quality int")
    known = np.array([2**60], "i8")
    assert np.isin(np.array([r["doc_id"] for r in big.collect()]), known).sum() == 1 and marks.count() == 1
    assert {r["doc_id"] for r in quality_classifier.score(big, model).collect()} == {2**60, 2**60 + 1}


def test_clashing_names_of_kept_columns(spark):
    df = spark.createDataFrame([(1, "the old stone bridge", "a", "b", "c")], "doc_id long, text string, spans string, __text string, text_ string")
    ranks = token_file("byte_bpe_50k.tiktoken")
    assert secrets.scan(df, ranks, keep=("doc_id", "spans", "__text", "text_")).columns == ["doc_id", "__text", "text_", "spans"]
    assert secrets.scan(df, ranks, keep=("doc_id", "spans", "__text", "text_")).first()["text_"] == "c"
    assert secrets.scan(df, ranks, keep=()).first()["spans"] == []
    model = language_id.train(spark.createDataFrame([(k, "the old stone bridge", "en") for k in range(5)], "doc_id long, text string, lang string"))
    assert language_id.predict(df, model, keep=("doc_id", "__text", "text_", "text")).first()["text"] == "the old stone bridge"


def test_classifier_on_repeated_rows(spark):
    text = "the river and the old stone bridge were quiet that evening"
    rows = [(1, text, "a", "en")] * 300 + [(2, "buy $$$ now !!! ###", "b", "en")] * 300 + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (9, 1), (None, 0)], "doc_id long, quality int")
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).groupBy("doc_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lo"] == by[1]["hi"] > 0.5 > by[2]["hi"] == by[2]["lo"] and by[None]["hi"] == 0


# 9


def plain_division(name, cost, unknown):
    best = {0: (0.0, [])}
    for j in range(1, len(name) + 1):
        best[j] = min((best[i][0] + cost.get(name[i:j], unknown + url_filter.UNKNOWN_LETTER * (j - i)), best[i][1] + [name[i:j]]) for i in range(j))
    return best[len(name)]


def test_division_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        name = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
        cost = {"".join(rng.choice(list("abc"), rng.integers(1, 5))): float(rng.uniform(1, 9)) for _ in range(12)}
        got = url_filter.divide(name, cost, 9.0)
        price = sum(cost.get(w, 9.0 + url_filter.UNKNOWN_LETTER * len(w)) for w in got)
        assert "".join(got) == name and abs(price - plain_division(name, cost, 9.0)[0]) < 1e-9


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_urls_held_out(spark, url_model):
    """Names that join, number and nest words in ways the labelled examples do not have."""
    bad = ["freecasinobonus", "cheappillsonline24", "adultxxxvideos", "spamlinksfarm", "bestpokerbets", "fastpaydayloans", "pornvideosfree", "ads-tracker-pixel", "jackpot-slots-win", "wareztorrentcrack"]
    good = ["dailynewsblog", "cityschoollibrary", "sciencejournal", "organicfarmmarket", "travelguide24", "musicreviewclub", "opensourcecode", "weather-report", "museumarthistory", "publichealthclinic"]
    rows = [(k, f"http://www.{h}.com.br/page/{k}", None) for k, h in enumerate(bad + good)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_model, rules=()).collect()}
    right = sum((got[k]["verdict"] == "block") == (k < len(bad)) for k in range(len(rows)))
    assert right >= 0.9 * len(rows)
    assert "casino bonus" in got[0]["words"] and "cheap pills" in got[1]["words"]


def test_pages_of_bad_hosts_are_blocked(spark, url_model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    names = {"spam-farm", "casino-win", "free-bets", "adult-x", "ads-track", "cheap-pills"}
    for r in url_filter.judge(pages, url_model).where("rule IS NULL").collect():
        assert (r["verdict"] == "block") == bool(names & set(r["host"].split(".")))
        assert " example" in f" {r['words']}"


@pytest.mark.parametrize("others", [0, 350])
def test_syllables_of_labelled_words_teach_nothing(spark, others):
    """No odds are learned for syllables of labelled words, however frequent in the pages; among other words, these stay whole."""
    text = "nu de ga m ble hot el " + " ".join(chr(97 + k % 26) + chr(97 + k // 26) * 5 for k in range(others))
    pages = spark.createDataFrame([(k, f"http://a.b/x/{k}", text) for k in range(100)], "page_id long, url string, html string")
    model = url_filter.train(pages)
    assert not {"nu", "de", "ga", "m", "ble", "el"} & {r["word"] for r in model.odds.collect()}
    rows = [(1, "http://www.nude.com/"), (2, "http://gamble.m.org/"), (3, "http://m.tionsh.net/de/1"), (4, "http://hotel.com/de/")]
    got = {r["page_id"]: (r["words"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), model, rules=()).collect()}
    assert got[3] == ("m tionsh de", "allow")
    if others:
        assert got[1] == ("www nude", "block") and got[2] == ("gamble m", "block") and got[4] == ("hotel de", "allow")


def test_odd_urls(spark, url_model):
    long_path = "casino" + "x" * 3000
    rows = [(1, None), (1, None), (2, f"http://a.b/{long_path}"), (3, "http://a.b/" + "/".join(["free"] * 2000)), (None, "HTTP://A.COM./en/"), (5, "http://[::1]:80/x"), (6, "://"), (7, "x://example.com/en/7"), (8, "x://example.com/en/7")]
    pages = spark.createDataFrame([(*r, None, "v") for r in rows], "page_id long, url string, html string, verdict string")
    rules = (("example.com", "/en/7", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/7", "block"))
    got = url_filter.judge(pages, url_model, rules, keep=("page_id", "verdict")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["host"] == by[1]["path"] == "" and by[1]["verdict"] == "allow" and by[1]["rule"] is None
    assert by[7]["rule"] == by[8]["rule"] == "example.com/en/7" and by[7]["verdict"] == "allow"
    assert by[2]["words"].startswith("a casino")
    given = spark.createDataFrame([("http://zork.x/", "block"), ("http://fine.x/", "allow"), ("http://fine.x/", "odd")], "url string, verdict string")
    own = url_filter.train(pages, given)
    judged = url_filter.judge(spark.createDataFrame([(1, "http://zorkzork.zork.com/"), (2, "http://fine.com/")], "page_id long, url string"), own, rules=())
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "allow"}


# 10


def test_warc_long_pages_and_shared_payloads(spark):
    rng = np.random.default_rng(0)
    huge = "<p>" + " ".join(map(str, rng.integers(0, 10**9, 300_000)))
    rows = [(9, "http://a/", huge), (4, "http://b/", huge), (5, "http://c/" + "x" * 5000, huge + "."), *[(100 + k, "http://d/", "<b>" + "same" * 40) for k in range(300)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = shared_dir(spark, "w")
    index = warc.write_archives(warc.plan_records(pages), folder)
    got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(got) == len(rows)
    assert got[9]["record_type"] == "revisit" and got[9]["refers_to"] == 4 and got[9]["payload_bytes"] == len(huge)
    assert bytes(got[4]["payload"]).decode() == huge and got[5]["record_type"] == "response"
    assert [got[100 + k]["refers_to"] for k in range(300)] == [None] + [100] * 299


def test_rules_under_filters(spark):
    """A filter on a measure is pushed below the projections; each text is still measured a bounded number of times."""
    rng = np.random.default_rng(5)
    text = " ".join("the" if k % 10 == 0 else w for k, w in enumerate(prose(rng, 10_000).split()))
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    judged = quality_rules.apply_rules(df)
    assert judged.where("kept").count() == judged.where("n_words = 10000 AND stop_ratio = 0.1 AND size(failed_rules) = 0").count() == 20
    assert quality_rules.kept_rows(df.where("doc_id < 5")).where("doc_id > 2").count() == 2


def test_join_heads_of_several_texts(spark, monkeypatch):
    """Rows of one id with different texts, and a document with more partners than one task verifies."""
    monkeypatch.setattr(ngram_join, "PARTNERS", 4)
    rng = np.random.default_rng(8)
    one, two = prose(rng, 80).split(), prose(rng, 80).split()
    near = lambda w, k: " ".join([*w[:k], f"x{k}", *w[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), *[(10 + k, near(one, 5 * k)) for k in range(12)], *[(40 + k, near(two, 5 * k)) for k in range(12)], (90, prose(rng, 80))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert {k for k, c in got.items() if c == 1} == {1, *range(10, 22), *range(40, 52)} and got[90] == 90


# Names that the labelled list does not have, joined and with hyphens; half of their words are not on it in any form.
UNLISTED_BAD = (
    "hookup-tonight gambling-hall cialis-discount baccaratvip stolen-cards erotic-massage forexscam steroids-shop gamblers-den pornstars casinoroyal viagras spamming lotteries erotica "
    "sportsbook-live keno-draws phishers hackers-forum spam-farm casino-win free-bets adult-x ads-track cheap-pills"
).split()
UNLISTED_GOOD = (
    "farm-links-golf golf-club-news schoolhouse bookshop healthcare newspaper librarian gardening museums-guide photography universities cooking-blog weatherman travelling historian kitchenware "
    "musicians hospital-map dictionary openstreetmap thtionshand ueberstein ledeslais"
).split()


def test_urls_of_unlisted_names(spark):
    assert not {n.replace("-", " ") for n in UNLISTED_BAD} & set(url_filter.BLOCKED_EXAMPLES)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html")
    rows = [(i, f"http://www.{n}.test/") for i, n in enumerate(UNLISTED_BAD + UNLISTED_GOOD)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.train(pages)).collect()}
    right = [got[i] == ("block" if i < len(UNLISTED_BAD) else "allow") for i, _ in rows]
    good = right[len(UNLISTED_BAD) :]
    assert sum(right) >= 0.85 * len(right) and sum(good) >= 0.95 * len(good)


def test_url_scores_plain(spark):
    """Odds of words and pieces, and the score, against a plain version on labelled urls of one's own."""
    import math

    labelled = [("http://bad-thing.a/worse", "block"), ("http://bad.b/", "block"), ("http://nice.c/thing", "allow"), ("http://wonderful-day.d/", "allow"), ("http://odd.e/", "unsure")]
    pages = spark.createDataFrame([("http://badly-wonder.x/thing/new", "<p>badly wonder new</p>"), ("http://x.y/", None)], "url string, html string").withColumn("page_id", F.monotonically_increasing_id())
    model = url_filter.train(pages, spark.createDataFrame(labelled, "url string, verdict string"))
    bad, good = collections.Counter("bad thing worse bad".split()), collections.Counter("nice thing wonderful day".split())
    every = set(bad) | set(good)
    share = lambda c, k, v, keys: math.log((c[k] + v) / (sum(c.values()) + v * len(keys)))
    odds = {w: share(bad, w, url_filter.SMOOTHING, every) - share(good, w, url_filter.SMOOTHING, every) for w in every}
    of = lambda w: [f"^{w}$"[k : k + 4] for k in range(len(w) - 1)] if len(w) >= url_filter.LEAST_PIECED else []
    bad_pieces, good_pieces = (collections.Counter(p for w in c for p in of(w)) for c in (bad, good))
    pieces = set(bad_pieces) | set(good_pieces)
    piece_odds = {p: share(bad_pieces, p, url_filter.PIECE_SMOOTHING, pieces) - share(good_pieces, p, url_filter.PIECE_SMOOTHING, pieces) for p in pieces}
    score = lambda ws: sum(odds[w] if w in odds else url_filter.PIECE_SHARE * sum(piece_odds.get(p, 0.0) for p in of(w)) for w in ws)
    bias = math.log(url_filter.PRIOR_BLOCK / (1 - url_filter.PRIOR_BLOCK))
    got = {r["host"]: (r["words"], r["bad_score"]) for r in url_filter.judge(pages, model).collect()}
    assert got["badly-wonder.x"][0] == "badly wonder thing new"
    assert abs(got["badly-wonder.x"][1] - 1 / (1 + math.exp(-bias - score("badly wonder thing new".split())))) < 1e-9
    assert abs(got["x.y"][1] - 1 / (1 + math.exp(-bias - score(["x"])))) < 1e-9


def test_sketches_of_long_sets(spark):
    """Sketches of different lengths are met at the shorter one, and never say that sets differ in more than they do."""
    rng = np.random.default_rng(9)
    rows, sets = [], []
    base = rng.integers(-(2**62), 2**62, 5000)
    for k in range(30):
        s = np.unique(np.concatenate([base[: rng.integers(1200, 5000)], rng.integers(-(2**62), 2**62, rng.integers(1, 2500))]))
        bits = max(ngram_join.SKETCH, 1 << (max(len(s) // 2, 1) - 1).bit_length())
        odd = (np.bincount(s & (bits - 1), minlength=bits) & 1).astype("u1")
        rows.append((k, np.packbits(odd, bitorder="little").view("<i8").tolist()))
        sets.append(set(s.tolist()))
    assert len({len(r[1]) for r in rows}) > 1
    df = spark.createDataFrame(rows, "k int, s array<long>")
    both = df.alias("a").join(df.alias("b"), F.col("a.k") < F.col("b.k")).select(F.col("a.k").alias("x"), F.col("b.k").alias("y"), ngram_join.apart(F.col("a.s"), F.col("b.s")).alias("d"))
    for r in both.collect():
        assert 0 < r["d"] <= len(sets[r["x"]] ^ sets[r["y"]])
