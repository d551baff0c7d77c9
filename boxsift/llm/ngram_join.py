"""N-gram Jaccard join: a grouped prefix join over shingle sets, exact, with connected components of the links.

A set's elements stand in one global order, rare ones first; two sets that reach the Jaccard threshold share an element
of their prefixes, the first |x| - ceil(t |x|) + 1 elements. The steps:

1. Equal sets become one class (its smallest doc_id stands for it). Classes with identical prefix and size become one
   group; members are verified against the group's representative and leave the group if they do not link.
2. Groups that share a prefix element are paired and filtered: by size, by position of the shared element, and by the
   difference that their sketches prove, less how far members' sketches lie from their group's. Pairs left over are verified
   on their texts, which travel to one document of the pair, representatives first, then expanded to all members unless the
   representatives linked.
3. Links become components; component_id is the smallest doc_id.

Only connectivity is wanted, so pairs within one component need no look. A short list of groups under an element is
paired in full. A long one is resolved around pivots: pivots are compared with every group of another component until
the list has one component only, so no link between different texts is lost and no list is squared.

Elements that are frequent in some stretch of the input are counted over all of it and put last in the order; at most
``FREQUENT`` of them, a fixed size, are sent to all tasks. The order decides the cost only: for any order the result is
the same. Lists of frequent elements are never gathered in one task; other lists stream through sorted partitions.

Defined results: a null, empty or wordless text has no shingle, links with nothing and is its own component; rows with
equal texts form one class; rows that share a doc_id count as one document in the components; a null doc_id links
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxsift.llm.common import columns_of, free_name, map_batches, most_frequent, written
from boxsift.llm.graph import components
from boxsift.llm.shingles import set_key, shingle_hashes, shingle_sets, text_chunks

WORDS, PERCENT = 5, 80
#: Elements put last in the order, and how often one must occur in a stretch of STRETCH elements to be counted.
FREQUENT, LOCAL_COUNT, STRETCH = 1 << 18, 4, 2_000_000
#: A list up to this length is paired in full; pivots in the rounds over longer ones, few enough that Spark keeps the best
#: of each task before it deals lists out (up to spark.sql.optimizer.windowGroupLimitThreshold, 1,000).
SHORT_LIST, SECOND_PIVOTS, LATER_PIVOTS = 64, 16, 512
#: Least bits of a set's parity sketch; it has half as many as the set has elements, rounded up to a power of two, as one
#: of fixed size could not tell long sets apart. Sets differ in at least as many elements as their sketches in bits.
SKETCH = 1024
#: Ids up to this count (16 MB) are broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Rows with a sketch (some 200 bytes) up to this count are broadcast; beyond it a component's groups are dealt out over SALTS.
BROADCAST_SKETCHES, SALTS = 100_000, 16
#: Partners of a document that are verified in one task.
PARTNERS = 1000


def _frequent(n: int):
    """Elements that come often in a stretch of the input: (element, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(u[often]), pa.array(c[often])], ["element", "n"])

        for _, raw in text_chunks(batches):
            held.append(shingle_hashes(raw, n)[0].view("i8"))
            size += len(held[-1])
            if size > STRETCH:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return run


def frequent_elements(docs: DataFrame, n: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of them by count over all documents, sorted by element; and their counts. Of bounded size."""
    counts = map_batches(docs.select("text"), _frequent(n), "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    got = most_frequent(counts, most, "join-frequent").toArrow()
    element, n_of = got.column("element").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(element)
    return element[order], n_of[order]


def _prefixes(n: int, percent: int, element: np.ndarray, count: np.ndarray):
    """(doc_id, n, set_key, rare, prefix, sketch): rare is the number of elements that are not frequent; sketch has a bit
    for each class of elements, set if the set has an odd number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_chunks(batches):
            sets = shingle_sets(raw, n)
            keys, rare, prefix, sketch = [], [], [], []
            for s in sets:
                keys.append(set_key(s) if len(s) else None)
                bits = max(SKETCH, 1 << (max(len(s) // 2, 1) - 1).bit_length())
                odd = (np.bincount(s & (bits - 1), minlength=bits) & 1).astype("u1")
                sketch.append(np.packbits(odd, bitorder="little").view("<i8"))
                weight = np.zeros(len(s), "i8")
                if len(element) and len(s):
                    at = np.minimum(np.searchsorted(element, s), len(element) - 1)
                    weight = np.where(element[at] == s, count[at], 0)
                rare.append(int((weight == 0).sum()))
                take = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                prefix.append(s[np.lexsort((s, weight))[:take]])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype("i4")
            values = np.concatenate(prefix) if prefix else np.empty(0, "i8")
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(rare, pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
            bits = pa.array(sketch, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, lists, bits], ["doc_id", "n", "set_key", "rare", "prefix", "sketch"])

    return run


def _short_lists(percent: int):
    """From rows (element, gid, n, at, lead) sorted by element, the pairs (a, b) of every list up to SHORT_LIST; for a longer
    list also a row with its element alone (long), which is resolved elsewhere. Only SHORT_LIST rows of a list are held.

    lead is the first element of the prefix: groups with the same one are paired there, and not again at later elements.
    """

    def near(a: tuple, b: tuple, element: int) -> bool:
        (_, n, at, lead), (_, m, bt, other) = a, b
        if lead == other and lead != element:
            return False
        if 100 * min(n, m) < percent * max(n, m):
            return False
        return (100 + percent) * (1 + min(n - at - 1, m - bt - 1)) >= percent * (n + m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element, held, long = None, [], False
        for batch in batches:
            a, b, longs = [], [], []
            e = batch.column("element").to_numpy()
            # Rows whose element differs from both neighbours pair with nothing.
            alone = np.concatenate([[True], e[1:] != e[:-1]]) & np.concatenate([e[1:] != e[:-1], [True]])
            alone[:1] = alone[-1:] = False
            at = np.flatnonzero(~alone)
            rows = zip(*(batch.column(c).to_numpy()[at].tolist() for c in ("gid", "n", "at", "lead")))
            for x, row in zip(e[at].tolist(), rows):
                if x != element:
                    element, held, long = x, [], False
                if long:
                    continue
                if len(held) == SHORT_LIST:
                    longs.append(x)
                    long = True
                    continue
                for other in held:
                    if other[0] != row[0] and near(other, row, x):
                        a.append(min(other[0], row[0]))
                        b.append(max(other[0], row[0]))
                held.append(row)
            none = [None] * len(longs)
            columns = [pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array([None] * len(a) + longs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "long"])

    return run


def _verified(n: int, percent: int):
    """Rows (head, id, text), those of a head together and the head's own ahead of its partners, as (a, b, linked) with a the
    head: one set is held beside the batch at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                sets = shingle_sets([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], n)
                heads, ids, linked = [], [], []
                for head, x, s in zip(b.column("head").to_pylist(), b.column("id").to_pylist(), sets):
                    if x == head:  # rows that share an id with different texts are one document
                        at, held = head, [*held, s] if head == at else [s]
                        continue
                    assert head == at, "a partner came without its head"
                    shared = [(len(np.intersect1d(h, s, assume_unique=True)), len(h)) for h in held]
                    heads.append(head)
                    ids.append(x)
                    linked.append(any(k and 100 * k >= percent * (size + len(s) - k) for k, size in shared))
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(ids, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


class _Join:
    """The tables of one join, and the steps that examine pairs."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent = n, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.element, self.count = frequent_elements(self.docs, n)
        kinds = "doc_id long, n long, set_key binary, rare long, prefix array<long>, sketch array<long>"
        self.sets = written(map_batches(self.docs, _prefixes(n, percent, self.element, self.count), kinds), "join-sets")
        self.n_docs = self.sets.count()  # bounds the tables that have a row for each document, class or group
        real = self.sets.where("n > 0 AND doc_id IS NOT NULL")
        classes = real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "rare", "prefix", "sketch")])
        group = F.xxhash64("n", "prefix")
        self.classes = written(classes.withColumn("gkey", group), "join-classes", self.n_docs)

    # Texts

    def pick_texts(self, ids: DataFrame) -> None:
        """Keep the texts of the documents in ids (id) at hand for verification."""
        ids = written(ids.distinct(), "join-ids", self.n_docs)
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        picked = self.docs.join(ids, self.docs["doc_id"] == ids["id"], "left_semi")
        self.texts = written(picked.select(F.col("doc_id").alias("id"), "text"), "join-texts", self.n_docs)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of pairs (a, b) of different documents, on their texts.

        Each text travels to its partners' head a, so a pair moves one text and a head one for each PARTNERS of its pairs:
        a head with more is dealt out over several tasks.
        """
        pairs = written(pairs.select("a", "b").where("a <> b").distinct(), "join-to-verify")
        deal = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        told = pairs.join(deal.where("parts > 1"), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)))
        legs = told.select(F.col("b").alias("id"), F.col("a").alias("head"), "part")
        heads = told.select(F.col("a").alias("id"), F.col("a").alias("head"), "part").distinct()
        routes = written(legs.union(heads), "join-routes")
        moved = self.texts.join(small(routes), "id").repartition("head", "part")
        moved = moved.sortWithinPartitions("head", "part", F.col("id") != F.col("head")).select("head", "id", "text")
        return written(map_batches(moved, _verified(self.n, self.percent), "a long, b long, linked boolean"), "join-verified")

    # Groups

    def form_groups(self) -> DataFrame:
        """Links found within groups; leaves groups (gid, n, rare, prefix) and members (gid, rep)."""
        heads = written(self.classes.groupBy("gkey").agg(F.min("rep").alias("gid"), F.count("*").alias("size")), "join-heads", self.n_docs)
        crowd = heads.where("size > 1")
        inside = self.classes.select("gkey", "rep").join(crowd, "gkey").where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
        self.inside = written(inside, "join-inside", self.n_docs)
        self.pick_texts(self.inside.select(F.col("a").alias("id")).union(self.inside.select("b")))
        checked = self.verify(self.inside)
        self.alone = self.inside.isEmpty()  # every group is a single class: nothing to expand
        joined = checked.where("linked").groupBy("b").agg(F.min("a").alias("gid"))
        joined = written(joined, "join-members", self.n_docs)
        members = self.classes.select("rep", "n", "rare", "prefix", "sketch").join(joined.withColumnRenamed("b", "rep"), "rep", "left")
        members = written(members.withColumn("gid", F.coalesce("gid", "rep")), "join-groups", self.n_docs)
        self.members = members.select("gid", "rep")
        self.crowded = written(self.members.where("rep <> gid").select("gid").distinct(), "join-crowded", self.n_docs)
        # A group is told by its representative's sketch and by how far its members' sketches lie from that.
        heads = members.where("rep = gid").select("gid", "n", "rare", "prefix", "sketch")
        near = heads.select("gid", F.col("sketch").alias("own")).join(small(self.crowded), "gid", "left_semi")
        slack = members.where("rep <> gid").join(near, "gid").groupBy("gid").agg(F.max(apart(F.col("sketch"), F.col("own"))).alias("slack"))
        slack = written(slack, "join-slack", self.n_docs)
        self.groups = heads.join(small(slack), "gid", "left").withColumn("slack", F.coalesce("slack", F.lit(0)))
        return checked.where("linked").select("a", "b")

    def postings(self) -> DataFrame:
        return self.groups.select("gid", "n", "rare", F.get("prefix", F.lit(0)).alias("lead"), F.posexplode("prefix").alias("at", "element"))

    def could_link(self, a: str, b: str) -> Column:
        """What sizes and sketches still allow: sets that link differ in (100 - percent) / (100 + percent) of their summed
        sizes at most, and members' sketches differ by no less than those of their groups less both groups' slack."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        sizes = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        least = apart(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) - F.col(f"{a}.slack") - F.col(f"{b}.slack")
        return sizes & ((100 + self.percent) * least <= (100 - self.percent) * (n + m))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of groups that sizes and sketches allow."""
        g = self.groups.select("gid", "n", "sketch", "slack")
        both = pairs.join(g.alias("x"), F.col("a") == F.col("x.gid")).join(g.alias("y"), F.col("b") == F.col("y.gid"))
        return both.where(self.could_link("x", "y")).select("a", "b")

    def expand(self, failed: DataFrame) -> DataFrame:
        """Member pairs of group pairs whose representatives do not link, without the representatives themselves."""
        m, crowded = self.members, self.crowded
        left = failed.join(crowded, F.col("a") == F.col("gid"), "left_semi").union(failed.join(crowded, F.col("b") == F.col("gid"), "left_semi")).distinct()
        both = left.join(m.alias("x"), F.col("a") == F.col("x.gid")).join(m.alias("y"), F.col("b") == F.col("y.gid"))
        return both.where("NOT (x.rep = a AND y.rep = b)").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

    def examine(self, pairs: DataFrame) -> DataFrame:
        """The links that pairs (a, b) of groups, filtered already, turn out to have: representatives, then members."""
        checked = self.verify(pairs)
        if self.alone:
            return checked.where("linked").select("a", "b")
        more = written(self.expand(checked.where("NOT linked").select("a", "b")), "join-expanded")
        links = checked.where("linked").select("a", "b")
        return links.union(self.verify(more).where("linked").select("a", "b")) if not more.isEmpty() else links

    def short_pairs(self, postings: DataFrame) -> DataFrame:
        """(a, b, long) from the lists of elements that are not frequent."""
        streamed = postings.select("element", "gid", "n", "at", "lead").repartition("element").sortWithinPartitions("element")
        return written(map_batches(streamed, _short_lists(self.percent), "a long, b long, long long").distinct(), "join-short")

    def resolve(self, lists: DataFrame, done: DataFrame, links: list[DataFrame]) -> DataFrame:
        """Rounds of pivots over lists (element, gid, rare) until each has one component; returns the roots.

        done has the (element, gid) that were compared with all of their list. Pivots are the groups with the fewest
        elements of their own, so the most central; after the first of these rounds, those outside the main component.
        """
        g = self.groups.select("gid", "n", "sketch", "slack")
        first, roots, n_lists = True, components(_union(links)), lists.count()
        while True:
            left = lists.join(small(done), ["element", "gid"], "left_anti").drop("label")
            left = left.join(small(roots).withColumnRenamed("node", "gid"), "gid", "left").withColumn("label", F.coalesce("root", "gid")).drop("root")
            split = left.groupBy("element").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("element")
            lists = written(left.join(self.few(split), "element", "left_semi"), "join-lists", n_lists)
            if lists.isEmpty():
                return roots
            by_label = lists.groupBy("element", "label").agg(F.count("*").alias("k"))
            main = by_label.groupBy("element").agg(F.max(F.struct("k", "label")).alias("m")).select("element", F.col("m.label").alias("main"))
            told = lists.join(self.few(main), "element")
            free = told if first else told.where("label <> main")
            rank = Window.partitionBy("element").orderBy("rare", "gid")
            picked = free.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= (SECOND_PIVOTS if first else LATER_PIVOTS))
            picked = written(picked.select("element", "gid", "label", "main"), "join-picked", n_lists)
            done = picked.select("element", "gid")
            # Lists with the same main component are met at once, so a pair is made once, not at each shared element. Groups
            # are dealt out over SALTS tasks for each component, and its pivots go to all of them.
            p = written(picked.select("main", "gid", "label").distinct().join(g, "gid"), "join-pivots", self.n_docs)
            few = p.count() <= BROADCAST_SKETCHES
            p = (F.broadcast(p) if few else p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))).alias("p")
            o = told.select("main", "gid", "label").distinct().join(g, "gid")
            o = (o if few else o.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int"))).alias("o")
            met = (F.col("p.main") == F.col("o.main")) & (F.col("p.label") != F.col("o.label")) & self.could_link("p", "o")
            met = met if few else met & (F.col("p.salt") == F.col("o.salt"))
            new = p.join(o, met).select(F.least("p.gid", "o.gid").alias("a"), F.greatest("p.gid", "o.gid").alias("b")).distinct()
            links.append(self.examine(written(new, "join-candidates")))
            first, roots = False, components(_union([roots.select(F.col("node").alias("a"), F.col("root").alias("b")), links[-1]]))

    def few(self, rows: DataFrame) -> DataFrame:
        """Rows of which each element has one: broadcast while there are few elements."""
        return F.broadcast(rows) if self.n_elements <= BROADCAST_IDS else rows


def apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, at the length of the shorter one."""
    k = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        at = lambda j: F.aggregate(F.sequence(j, F.size(x) - 1, k), F.lit(0).cast("long"), lambda total, i: total.bitwiseXOR(F.get(x, i)))
        return F.when(F.size(x) > k, F.transform(F.sequence(F.lit(0), k - 1), at)).otherwise(x)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if a count proves it small."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text); links need a Jaccard of percent / 100."""
    join = _Join(docs, n, percent)
    links = [join.form_groups()]
    postings = join.postings()
    frequent = docs.sparkSession.createDataFrame(pa.table({"element": pa.array(join.element, pa.int64())}))  # FREQUENT at most
    short = join.short_pairs(postings.join(F.broadcast(frequent), "element", "left_anti"))
    elements = written(frequent.union(short.where("long IS NOT NULL").select("long")), "join-elements")
    join.n_elements = elements.count()
    lists = written(postings.select("element", "gid", "rare").join(join.few(elements), "element", "left_semi"), "join-lists")
    pivots = lists.groupBy("element").agg(F.min(F.struct("rare", "gid")).alias("p"), F.count("*").alias("k")).where("k > 1")
    pivots = written(pivots.select("element", F.col("p.gid").alias("pivot")), "join-pivots")
    star = lists.join(join.few(pivots), "element").where("gid <> pivot")
    star = star.select(F.least("gid", "pivot").alias("a"), F.greatest("gid", "pivot").alias("b")).distinct()
    pairs = written(star.union(short.where("a IS NOT NULL").select("a", "b")).distinct(), "join-pairs")
    candidates = written(join.filtered(pairs), "join-candidates")
    # Texts are picked once: of the groups in a candidate pair or a list of two or more, with all of their members.
    looked = candidates.select(F.col("a").alias("id")).union(candidates.select("b"))
    looked = looked.union(lists.join(join.few(pivots), "element").select("gid"))
    looked = written(looked.distinct(), "join-looked-at", join.n_docs)
    join.pick_texts(join.members.join(small(looked), F.col("gid") == F.col("id"), "left_semi").select(F.col("rep").alias("id")))
    # First one pair for each group, its smallest partner; then only pairs that this left in different components.
    chosen = written(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "join-chosen", join.n_docs)
    links.append(join.examine(chosen))
    label = small(components(_union(links))).withColumnRenamed("node", "id")
    others = candidates.join(chosen, ["a", "b"], "left_anti")
    for side in "ab":
        named = label.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
        others = others.join(named, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    others = written(others.where("root_a <> root_b").select("a", "b"), "join-others")
    links.append(join.examine(others))
    roots = join.resolve(lists, pivots.select("element", F.col("pivot").alias("gid")), links)
    # Classes to components, documents to classes.
    named = join.classes.select("set_key", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = written(named.select("set_key", F.coalesce("root", "rep").alias("component_id")), "join-named", join.n_docs)
    out = join.sets.select("doc_id", "n", "set_key").join(named, "set_key", "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of its component; of rows that share a
    doc_id the one with the smallest text stays, one of equals. Rows with a null doc_id stay.

    No column's name can clash: what is joined has names that no column of docs has.
    """
    found = written(jaccard_components(docs, n, percent), "join-components")
    own = free_name(docs.columns, "join_")
    id_of, there = f"{own}id", F.col("doc_id").cast("long") == F.col(f"{own}id")
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_of)).distinct(), "join-gone")
    kept = docs.join(small(gone), there, "left_anti")
    twice = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_of)), "join-twice")
    if twice.isEmpty():
        return kept.select(*columns_of(docs))
    again = kept.join(small(twice), there, "left_semi").select(F.struct(*columns_of(docs)).alias("row"))
    one = again.groupBy("row.doc_id").agg(F.min_by("row", F.struct(F.col("row.text"), F.xxhash64("row"))).alias("row"))
    return kept.join(small(twice), there, "left_anti").select(*columns_of(docs)).union(one.select("row.*"))
