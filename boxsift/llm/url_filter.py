"""URL filters: longest-prefix rules first, then naive Bayes over segmented host and path words.

A host such as ``cheap-pillsonline.example.com`` is cut into words before it is scored: each stretch of letters in its
labels (but the last, which is a registry's) and in the path is divided by a unigram Viterbi search, which picks the
division with the highest product of word frequencies. Unigrams are counted over all pages: the words of the html's text
and of the paths, the parts of host labels with hyphens, and the words of the labelled urls, which make up a set share
(``KNOWN``) however many pages there are: else syllables that are frequent there would divide a labelled word wherever it
stands. In the labelled urls themselves such words are never divided, so that no syllable is judged by them. Multinomial naive Bayes then scores the words of host and path. A word that no labelled url has is scored by its pieces of four letters, counted over the
labelled words; one without a labelled piece says nothing.

No vocabulary is cut and no table is sent whole: distinct stretches are joined with the word counts on their substrings,
the search runs on each distinct stretch with the words found in it, and stretches, word odds and urls meet in joins that
Spark can split where a key is hot. A substring of more than ``MAX_WORD`` letters is taken for a word only if it is the
whole stretch.

Defined results: a url that is null or lacks ``://`` has an empty host and path, fits no rule and is allowed; equal
urls are judged alike; of rules that fit, the longest (host and path together) wins, a rule listed twice counts
once, and of two rules that differ in the verdict only, allow wins; a null html has no words; labelled urls with a verdict
other than allow and block are ignored, and without any the score is the prior; an empty table gives no rows; the columns
named in ``keep`` pass through, unless an output takes their name, and no other column but url, html and title is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches, written

#: Letters of the longest substring that is looked up, and of the blocks that a long stretch is looked up in.
MAX_WORD, BLOCK = 64, 1024
#: Share of urls taken to be bad before any word is seen, and what each word's count is raised by in either class.
PRIOR_BLOCK, SMOOTHING = 0.25, 0.1
#: Words of the labelled urls that are taken to be seen for each word of the pages, at least as many as there are.
KNOWN = 0.25
#: Cost of a letter of a stretch that is no word, beyond that of an unseen word.
UNKNOWN_LETTER = 2.5
#: Letters of the pieces by which a word that no labelled url has is judged, the least letters of such a word, what each piece's
#: count is raised by, and the share of a piece's odds that counts, as neighbouring pieces overlap.
PIECE, LEAST_PIECED, PIECE_SMOOTHING, PIECE_SHARE = 4, 5, 0.5, 0.5
#: Columns of pages whose words are counted, those there are.
TEXTS = ("html", "title")
#: Rules of the registered query: host, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
# Labelled examples for where no table of labelled urls is given, names of hosts and paths by what they offer.
BLOCKED_EXAMPLES = (
    # spam, link schemes, advertising, tracking
    "spam", "spammer", "spam mail", "bulk mail", "spam links", "backlinks", "link exchange scheme", "click bait", "click farm", "buy followers", "buy likes", "fake reviews",
    "ads", "ads server", "ad server", "ads banner", "banner ads", "ad tracker", "tracker", "tracking pixel", "pixel tracker", "popup", "popunder ads", "adware", "toolbar adware", "doorway",
    # gambling
    "casino", "casinos online", "online casino bonus", "casino jackpot", "jackpot", "slots", "slot machine casino", "poker", "poker bets", "bets", "bet bonus", "betting", "betting odds", "bookmaker odds",
    "gamble", "gambling", "roulette", "blackjack", "baccarat", "bingo jackpot", "lottery jackpot", "lotto winner", "sportsbook", "wager",
    # adult
    "porn", "porno", "porn tube", "xxx", "xxx videos", "sex", "sex cams", "sex chat", "adult", "adult cams", "adult dating", "nude", "nudes", "naked", "erotic", "escort", "escorts", "hookup", "hot singles", "fetish", "webcam girls", "milf",
    # medicine, money, fraud
    "viagra", "cheap viagra", "cialis", "cheap cialis", "levitra", "pills", "diet pills", "cheap meds", "online pharmacy cheap", "steroids", "opioids no prescription", "miracle cure", "weight loss miracle",
    "payday", "payday loans", "instant cash loans", "cheap loans", "replica", "replica watches", "cheap replica", "counterfeit", "fake diploma", "fake passport", "bitcoin doubler", "crypto giveaway", "forex scam", "get rich quick",
    "scam", "free prize", "prize winner", "free giveaway", "claim prize",
    # software and access
    "crack", "cracked", "keygen", "warez", "serial keygen", "torrent", "torrents", "pirate torrent", "malware", "trojan", "phishing", "stolen", "carding", "hacked accounts", "account stealer", "exploit kit",
)
ALLOWED_EXAMPLES = (
    "news", "daily news", "news video", "blog", "blog posts", "wiki", "wiki article", "docs", "guide", "school", "school library", "library", "city council", "council", "health", "health clinic", "clinic",
    "science", "science journal", "journal", "research", "research paper", "university", "university course", "open source", "source code", "software", "free software", "support", "help", "photo", "photo album", "travel", "travel guide",
    "recipes", "kitchen", "cooking recipes", "garden", "garden tips", "music", "music review", "book", "book club", "books", "film", "film history", "history", "museum", "art museum", "weather", "weather report", "sports", "sports results",
    "company", "about us", "shop", "shop products", "store", "forum", "forum thread", "archive", "archive index", "data", "data tables", "public", "public health", "mobile", "mobile site", "world", "world map", "map", "bank", "bank online",
    "online course", "video", "video lectures", "lectures", "farm", "farm market", "organic farm", "market", "running track", "golf links", "links", "hospital", "hospital pharmacy", "pharmacy", "tournament", "chess",
    "login", "account", "download", "download manual", "manual", "mail", "mail list", "chat", "chat support", "watches", "watches repair", "student loans", "loans office", "serial novel", "novel", "adult education", "education", "server status", "server",
    "food", "home", "family", "house", "water", "energy", "law", "legal", "court", "police", "fire station", "church", "parish", "theatre", "dance", "cinema", "radio", "magazine", "press", "print", "design", "studio", "engineering", "physics", "chemistry", "biology", "maths",
    "team", "club", "league", "football", "tennis", "cycling", "hiking", "camping", "hotel", "flights", "rail", "bus", "harbour", "fishing", "swimming", "training", "learning", "parking", "printing", "building", "banking", "meeting", "birds", "forest", "animals",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_hit(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The winning rule as text, and its verdict; null where none fits. Compiled into one CASE, best rule first."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[0], r[1], r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def examples(spark, blocked: Iterable[str] = BLOCKED_EXAMPLES, allowed: Iterable[str] = ALLOWED_EXAMPLES) -> DataFrame:
    """Labelled urls (url, verdict) of names given as words; in a path, where each stretch counts as a word."""
    rows = [(f"http://x/{x.replace(' ', '-')}/", v) for v, names in (("block", blocked), ("allow", allowed)) for x in names]
    return spark.createDataFrame(rows, "url string, verdict string")


def stretches(host: Column, path: Column) -> Column:
    """Stretches of letters of host and path, in order: those that are divided into words."""
    labels = F.regexp_replace(F.regexp_replace(host, "(?s):.*", ""), r"(?s)\.?[^.]*\z", "")
    return F.array_remove(F.split(F.lower(F.concat_ws("/", labels, path)), r"[^\p{L}]+"), "")


def visible_words(html: Column) -> Column:
    """Words of a page's text, in lower case."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return F.split(F.lower(bare), r"[^\p{L}]+")


def word_counts(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(word, n, given): how often it is in all pages and in the labelled urls."""
    host, path = split_url(F.col("url"))
    parts = F.flatten(F.transform(F.filter(F.split(F.regexp_replace(host, "(?s):.*", ""), r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, r"[^\p{L}]+")))
    of_url = F.concat(parts, F.split(F.lower(path), r"[^\p{L}]+"))
    texts = [visible_words(F.col(c)) for c in TEXTS if c in pages.columns]
    words = pages.select(F.explode(F.concat(of_url, *texts)).alias("word"), F.lit(0).alias("given"))
    words = words.union(labelled.select(F.explode(of_url).alias("word"), F.lit(1)))
    return words.where("word <> ''").groupBy("word").agg(F.count_if(F.col("given") == 0).alias("n"), F.sum("given").alias("given"))


def unigrams(counts: DataFrame, known: float = KNOWN) -> DataFrame:
    """(word, n) of ``word_counts``, the labelled words raised to their share."""
    sums = counts.agg(F.sum("n").alias("n"), F.sum("given").alias("given")).first()
    times = max(1.0, known * (sums["n"] or 0) / (sums["given"] or 1))
    return counts.select("word", (F.col("n") + F.ceil(F.col("given") * times)).alias("n"))


def divide(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest division of a name; a stretch that is no word costs more for each of its letters. Of equal ones the one
    whose last word starts first."""
    longest = max(map(len, cost), default=1)
    best, cut = [0.0], [0]
    for j in range(1, len(name) + 1):
        c, at = best[0] + unknown + UNKNOWN_LETTER * j, 0
        # Without a word's end here, only a stretch that is no word can end here: one letter more than the best one before.
        for i in range(max(0, j - max(longest, MAX_WORD)), j):
            w = name[i:j]
            option = best[i] + cost.get(w, unknown + UNKNOWN_LETTER * len(w))
            if option < c:
                c, at = option, i
        best.append(c)
        cut.append(at)
    words, j = [], len(name)
    while j:
        words.append(name[cut[j] : j])
        j = cut[j]
    return words[::-1]


def _divided(total: int):
    unknown = math.log(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, known = b.column("stretch").to_pylist(), b.column("known").to_pylist()
            words = [divide(s, {k["word"]: math.log(total / (k["n"] + 1)) for k in ks or ()}, unknown) for s, ks in zip(names, known)]
            yield pa.RecordBatch.from_arrays([b.column("stretch"), pa.array(words, pa.list_(pa.string()))], ["stretch", "words"])

    return run


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(stretch, words) of distinct stretches, by the counts (word, n)."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    size = F.length("stretch")
    blocks = names.select("stretch", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))).alias("block"))
    blocks = blocks.withColumn("part", F.substr("stretch", F.col("block") * BLOCK + 1, F.lit(BLOCK + MAX_WORD)))
    starts = blocks.select("stretch", "part", F.explode(F.sequence(F.lit(1), F.least(F.length("part"), F.lit(BLOCK)))).alias("i"))
    starts = starts.withColumn("part", F.substr("part", F.col("i"), F.lit(MAX_WORD)))
    pieces = starts.select("stretch", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda n: F.substr("part", F.lit(1), n))).alias("word"))
    pieces = pieces.union(names.where(size > MAX_WORD).select("stretch", F.col("stretch").alias("word")))
    known = pieces.join(counts, "word").groupBy("stretch").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    rows = names.join(known, "stretch", "left").select("stretch", "known")
    return map_batches(rows, _divided(sums["n"] + sums["words"] + 1), "stretch string, words array<string>")


def pieces(word: Column) -> Column:
    """Pieces of PIECE letters of a word and its ends; none of a short word."""
    whole = F.concat(F.lit("^"), word, F.lit("$"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (PIECE - 1), F.lit(1))), lambda i: F.substr(whole, i, F.lit(PIECE)))
    return F.when(F.length(word) >= LEAST_PIECED, every).otherwise(F.array().cast("array<string>"))


def log_odds(seen: DataFrame, key: str, smoothing: float) -> DataFrame:
    """(key, odds) of counts (key, bad, good): the logarithm of its smoothed share among the bad over that among the good."""
    sums = seen.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("*").alias("keys")).first()
    share = lambda c: F.log((F.col(c) + smoothing) / (sums[c] + smoothing * sums["keys"]))
    return seen.select(key, (share("bad") - share("good")).alias("odds"))


@dataclass
class UrlModel:
    """What the texts and the labelled urls teach, as written tables."""

    counts: DataFrame  # word, n
    odds: DataFrame  # word, odds: logarithm of its share among blocked words over that among allowed ones
    pieces: DataFrame  # piece, odds: the same of the pieces of labelled words
    bias: float


def train(pages: DataFrame, labelled: DataFrame | None = None, prior: float = PRIOR_BLOCK, smoothing: float = SMOOTHING) -> UrlModel:
    """Count the words of pages (url, and html or title) and fit on labelled urls (url, verdict)."""
    labelled = examples(pages.sparkSession) if labelled is None else labelled
    labelled = labelled.where("verdict IN ('allow', 'block')")
    counted = written(word_counts(pages, labelled), "url-words")
    counts = unigrams(counted)
    host, path = split_url(F.col("url"))
    names = labelled.select("verdict", F.explode(stretches(host, path)).alias("stretch"))
    # What is given as a word is not divided.
    given, distinct = counted.where("given > 0").select(F.col("word").alias("stretch")), names.select("stretch").distinct()
    words = segmented(distinct.join(given, "stretch", "left_anti"), counts)
    words = words.union(distinct.join(given, "stretch", "left_semi").select("stretch", F.array("stretch")))
    seen = names.join(words, "stretch").select("verdict", F.explode("words").alias("word"))
    seen = written(seen.groupBy("word").agg(F.count_if(F.col("verdict") == "block").alias("bad"), F.count_if(F.col("verdict") == "allow").alias("good")), "url-seen")
    odds = written(log_odds(seen, "word", smoothing), "url-odds")
    parts = seen.select(F.explode(pieces(F.col("word"))).alias("piece"), (F.col("bad") > 0).cast("int").alias("bad"), (F.col("good") > 0).cast("int").alias("good"))
    parts = written(parts.groupBy("piece").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-pieces-seen")
    return UrlModel(counts, odds, written(log_odds(parts, "piece", PIECE_SMOOTHING), "url-pieces"), math.log(prior) - math.log(1 - prior))


def odds_of(words: DataFrame, model: UrlModel) -> DataFrame:
    """(word, odds) of distinct words: as labelled, else by their pieces, else 0."""
    found = words.join(model.odds, "word", "left")
    new = found.where("odds IS NULL").select("word", F.explode(pieces(F.col("word"))).alias("piece")).join(model.pieces, "piece")
    by_piece = new.groupBy("word").agg((F.sum("odds") * PIECE_SHARE).alias("of_pieces"))
    return found.join(by_piece, "word", "left").select("word", F.coalesce("odds", "of_pieces", F.lit(0.0)).alias("odds"))


def judge(pages: DataFrame, model: UrlModel, rules: Iterable[tuple[str, str, str]] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, words, bad_score, rule and verdict of each url."""
    host, path = split_url(F.col("url"))
    split = ["host", "path"]
    rows = pages.select(*[c for c in keep if c not in (*split, "words", "bad_score", "rule", "verdict")], host.alias("host"), path.alias("path"))
    names = written(rows.select(*split).distinct(), "url-names")
    placed = names.select(*split, F.posexplode(stretches(F.col("host"), F.col("path"))).alias("at", "stretch"))
    words = written(segmented(placed.select("stretch").distinct(), model.counts), "url-segments")
    known = written(odds_of(words.select(F.explode("words").alias("word")).distinct(), model), "url-words-odds")
    told = words.select("stretch", "words", F.explode_outer("words").alias("word")).join(known, "word", "left")
    told = written(told.groupBy("stretch", "words").agg(F.coalesce(F.sum("odds"), F.lit(0.0)).alias("odds")), "url-told")
    found = placed.join(told, "stretch").groupBy(*split).agg(F.array_sort(F.collect_list(F.struct("at", "words", "odds"))).alias("found"))
    # Summed in the order of the url, so that the score does not depend on how rows were dealt.
    z = F.aggregate("found", F.lit(float(model.bias)), lambda a, x: a + x["odds"])
    scored = found.select(*split, F.array_join(F.flatten(F.transform("found", lambda x: x["words"])), " ").alias("words"), (1 / (1 + F.exp(-z))).alias("bad_score"))
    scored = written(scored, "url-scored")
    name, verdict = rule_hit(F.col("host"), F.col("path"), rules)
    judged = rows.join(scored, split, "left").withColumns({"words": F.coalesce("words", F.lit("")), "bad_score": F.coalesce("bad_score", F.lit(1 / (1 + math.exp(-model.bias))))})
    own = F.when(F.col("bad_score") >= 0.5, "block").otherwise("allow")
    return judged.withColumns({"rule": name, "verdict": F.coalesce(verdict, own)})
