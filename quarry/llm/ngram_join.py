"""Exact n-gram Jaccard self-join, reported as components, with set-relation skipping.

A text's set is its distinct word n-grams.  Two sets link if
100 * intersection >= least * union.

1. Equal sets are one class; from here on only classes are compared.
2. n-grams have one global order: by a sketch of their frequency, rare ones
   first, then by hash.  Linked sets share one of the first
   n - ceil(n * least / 100) + 1 of their n-grams, so only those prefixes are
   indexed.
3. The index lists hold (size, position) in order.  In each list the first entry
   of a run of compatible sizes is its hub, and every entry becomes a partner of
   its hub.  A hub's partners come together in slices of bounded size, once per
   hub and not per list.
4. Inside a slice all links are found, from the hub's answers: with the overlap
   of each partner with the hub z known gram by gram, one product of 0/1 matrices
   gives |x & y & z| of all pairs.  It bounds |x & y| from below, and with the
   smaller number of grams outside z from above; a pair that neither bound decides
   compares only its grams outside z.  Links that join nothing new are not
   reported.
5. Lists whose entries are by then in one component are skipped whole.  In the
   others, pairs that met in a slice are skipped, entries of one component are
   skipped, and blocks are skipped by position: entries at positions p, q of sets
   of sizes n, m share at most min(n - p, m - q) grams from there on.
6. What is left is compared; components are computed anew with all links.

No link is lost: linked sets share a list.  They meet in a slice (step 4), are
already in one component, or are compared in step 6.

Defined cases: null, empty or blank text has an empty set and links with nothing
(its component is its own id); a text of fewer words than n is one n-gram;
repeated rows link; rows with equal ids and different texts are separate; a null
id is no candidate for the smallest; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, add_columns, documents, map_rows, packed, same_text, stored, text_key
from quarry.llm.components import components

SKETCH_BITS = 18  # 16 at least
#: Bounds of a slice: sets, and n-grams in all of them.
SLICE_SETS, SLICE_GRAMS = 4000, 2_000_000
#: Columns of a 0/1 matrix at once.
COLUMNS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of the words of a text, A-Z as a-z, from its bytes at once.

    A word's hash is the sum of value(byte) * BASE ** place, taken from running sums
    over the text and divided by BASE ** (place of the word), all modulo 2**64.
    """

    BASE = 0x9E3779B97F4A7C15 | 5
    BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
    VALUE = np.array([0 if blank else xxhash.xxh3_64_intdigest(bytes([c]).lower()) for c, blank in enumerate(BLANK)], np.uint64)
    ANY_BLANK = re.compile(rb"[\x20\x09-\x0D]")

    def __init__(self, piece: int = 1 << 16):
        self.piece = piece
        self._powers(2 * piece)

    def _powers(self, n: int) -> None:
        self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(x)))) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def of(self, data: bytes) -> np.ndarray:
        """Hashes in the order of the words; a long text goes through in pieces cut at blanks."""
        out, start = [], 0
        while start < len(data):
            cut = self.ANY_BLANK.search(data, start + self.piece)
            end = cut.start() if cut else len(data)
            out.append(self._piece(np.frombuffer(data, np.uint8, end - start, start)))
            start = end
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, np.uint64)

    def _piece(self, b: np.ndarray) -> np.ndarray:
        if len(b) > len(self.power):
            self._powers(len(b))  # a word longer than a piece
        blank = np.ones(len(b) + 2, bool)
        blank[1:-1] = self.BLANK[b]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.VALUE[b] * self.power[: len(b)], out=sums[1:])
        h = (sums[edges[1::2]] - sums[edges[::2]]) * self.inverse[edges[::2]]
        h ^= h >> np.uint64(29)
        h *= MIX
        return h ^ (h >> np.uint64(32))


def shingles(data: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram."""
    h = hashes.of(data)
    if not len(h):
        return np.empty(0, np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def needed(least: int, n, m):
    """Smallest intersection of linked sets of sizes n and m."""
    return -(-least * (n + m) // (100 + least))


def prefix_length(least: int, n: int) -> int:
    return n + (-least * n // 100) + 1


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many (text, n-gram) pairs fall into each slot; over all texts."""

    def count(batches: Iterator[dict]) -> Iterator[list]:
        hashes, total = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            sets = [shingles((t or "").encode(), n, hashes) for t in b["text"]]
            total += np.bincount(slots(np.concatenate([np.empty(0, np.uint64), *sets])), minlength=len(total))
        at = np.flatnonzero(total)
        yield list(zip(at.tolist(), total[at].tolist()))

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    rows = map_rows(docs.select("text"), count, "slot int, k long").groupBy("slot").agg(F.sum("k").alias("k")).toArrow()  # at most a row per slot
    out[rows["slot"].to_numpy()] = rows["k"].to_numpy()
    return out


def rarity_levels(frequency: np.ndarray) -> np.ndarray:
    """Slots ranked by frequency, in 2**16 levels: a 16-bit order sorts in linear time."""
    level = np.empty(len(frequency), np.uint16)
    level[np.argsort(frequency, kind="stable")] = np.arange(len(frequency)) >> (SKETCH_BITS - 16)
    return level


def read_sets(docs: DataFrame, n: int, rarity: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """(doc_id, text_key, set_key, n, prefix) per row; set_key is null for empty sets, prefix without ``rarity``."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)  # 2 ** SKETCH_BITS numbers

    def run(batches: Iterator[dict]) -> Iterator[list]:
        hashes, rarity = WordHashes(), sent.value
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                data = (text or "").encode()
                h = shingles(data, n, hashes)
                key = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                prefix = None
                if rarity is not None:
                    k = prefix_length(least, len(h)) if len(h) else 0
                    order = np.argsort(rarity[slots(h)], kind="stable")[:k]  # of equal rarity by hash, as h is sorted
                    prefix = h[order].view(np.int64).tolist()
                out.append((doc_id, text_key(data), key, len(h), prefix))
            yield out

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, text_key long, set_key binary, n long, prefix array<long>")


def index_lists(classes: DataFrame, least: int) -> DataFrame:
    """(gram, node, place, hub): the index lists of at least two entries, in (size, position) order;
    ``place`` holds size and position."""
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "gram")).select("gram", "node", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))

    def run(batches: Iterator[dict]) -> Iterator[list]:
        rows = (r for b in batches for r in zip(b["gram"], b["node"], b["place"]))
        out: list[tuple] = []
        for gram, entries in groupby(rows, key=lambda r: r[0]):
            hub = first = None
            for _, node, place in entries:
                if hub is None:
                    hub, first = (node, place >> 32), (gram, node, place, node)
                    continue
                if first:  # the list has a second entry
                    out.append(first)
                    first = None
                if 100 * hub[1] < least * (place >> 32):
                    hub = node, place >> 32
                out.append((gram, node, place, hub[0]))
                if len(out) > 100_000:
                    yield out
                    out = []
        yield out

    return map_rows(entries.repartition("gram").sortWithinPartitions("gram", "place", "node"), run, "gram long, node long, place long, hub long")


def slice_of(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col("slices")).cast("int")


def sliced(pairs: DataFrame) -> DataFrame:
    """(u, slices) for pairs (u, v, nv): how many slices the partners of u need."""
    wanted = F.greatest(F.ceil(F.sum("nv") / SLICE_GRAMS), F.ceil(F.count("*") / SLICE_SETS))
    return pairs.groupBy("u").agg(wanted.cast("int").alias("slices"))


class Groups:
    """Which of some items are known to be together; tells unions that join something new."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == a] = b
        return a != b


def slice_links(hub: np.ndarray, sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Links that join the hub (index 0) and its partners (from 1), without those that join nothing new."""
    n = np.array([len(hub), *map(len, sets)])
    inside = [np.searchsorted(hub, s) for s in sets]
    inside = [(at, (at < len(hub)) & (hub[np.minimum(at, len(hub) - 1)] == s)) for at, s in zip(inside, sets)]
    shared = np.array([len(hub), *(int(hit.sum()) for _, hit in inside)])
    near = shared >= needed(least, n[0], n)
    links = [(0, int(i)) for i in np.flatnonzero(near[1:]) + 1]
    far = np.flatnonzero(~near)
    if not len(far):
        return links
    groups = Groups(len(n))
    groups.label[near] = 0
    outside = [np.empty(0, np.uint64), *(s[~hit] for s, (_, hit) in zip(sets, inside))]
    common = np.zeros((len(far), len(n)), np.float32)
    for lo in range(0, len(hub), COLUMNS):
        bits = np.zeros((len(n), min(COLUMNS, len(hub) - lo)), np.float32)
        bits[0] = 1
        for i, (at, hit) in enumerate(inside, 1):
            here = at[hit]
            bits[i, here[(here >= lo) & (here < lo + COLUMNS)] - lo] = 1
        common += bits[far] @ bits.T
    common = common.astype(np.int64)
    for row, i in enumerate(far.tolist()):
        need = needed(least, n[i], n)
        for j in np.flatnonzero(common[row] >= need).tolist():
            if groups.join(i, j):
                links.append((i, j))
        open_ = (common[row] + np.minimum(n[i] - shared[i], n - shared) >= need) & (groups.label != groups.label[i])
        for j in np.flatnonzero(open_).tolist():
            if groups.label[j] != groups.label[i]:
                more = len(np.intersect1d(outside[i], outside[j], assume_unique=True))
                if common[row, j] + more >= need[j] and groups.join(i, j):
                    links.append((i, j))
    return links


def compare(pairs: DataFrame, texts: DataFrame, n: int, least: int) -> DataFrame:
    """(u, v): links among each u and its partners, for ``pairs`` (u, v, nv); exactly, slice by slice."""
    sizes = sliced(pairs)
    partners = pairs.join(sizes, "u").select(F.col("v").alias("node"), "u", slice_of("v").alias("slice"), F.lit(1).alias("role"))
    heads = sizes.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"))
    sent = partners.unionByName(heads).join(texts, "node").select("u", "slice", "role", "node", "packed")

    def run(batches: Iterator[dict]) -> Iterator[list]:
        unpacker, hashes = zstandard.ZstdDecompressor(), WordHashes()
        rows = (r for b in batches for r in zip(b["u"], b["slice"], b["node"], b["packed"]))
        for _, members in groupby(rows, key=lambda r: r[:2]):
            nodes, sets = [], []
            for _, _, node, z in members:  # the hub comes first
                nodes.append(node)
                sets.append(shingles(unpacker.decompress(z), n, hashes))
            yield [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in slice_links(sets[0], sets[1:], least)]

    return map_rows(sent.repartition("u", "slice").sortWithinPartitions("u", "slice", "role", "node"), run, "u long, v long")


def open_pairs(lists: DataFrame, pairs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(u, v, nv): pairs of different components in a shared list that have not met in a slice."""
    named = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
    sizes = sliced(pairs).withColumnRenamed("u", "hub")
    # the hub itself has met the partners of every slice
    met = F.when(F.col("hub") == F.col("node"), -1).otherwise(slice_of("node"))
    entries = named.join(several, "gram").join(sizes, "hub", "left").select("gram", "place", "node", "hub", "component", F.coalesce(met, F.lit(-1)).alias("slice"))

    def run(batches: Iterator[dict]) -> Iterator[list]:
        columns = ("gram", "place", "node", "hub", "component", "slice")
        rows = (r for b in batches for r in zip(*(b[c] for c in columns)))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            place, node, hub, component, part = (np.array(c, np.int64) for c in list(zip(*group))[1:])
            size, pos = place >> 32, place & 0xFFFFFFFF
            first = 0
            for i in range(1, len(node)):
                while 100 * size[first] < least * size[i]:
                    first += 1
                before = slice(first, i)
                met = (hub[before] == hub[i]) & ((part[before] == part[i]) | (part[before] < 0) | (part[i] < 0))
                reach = np.minimum(size[i] - pos[i], size[before] - pos[before])
                keep = ~met & (component[before] != component[i]) & (reach >= needed(least, size[i], size[before]))
                out += [(node[i], j, n) for j, n in zip(node[before][keep].tolist(), size[before][keep].tolist())]
            if len(out) > 50_000:
                yield out
                out = []
        yield out

    found = map_rows(entries.repartition("gram").sortWithinPartitions("gram", "place", "node"), run, "u long, v long, nv long")
    return found.distinct()


def join(docs: DataFrame, n: int = 4, least: int = 85) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component) per row of ``docs``; ``component``
    numbers the components in this run and is null for empty sets."""
    # prefixes are most of what is read from the texts; they are stored once, with the classes
    rows = read_sets(docs, n, rarity_levels(frequency_sketch(docs, n)), least)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one")
    by_set = rows.where("n > 0").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # numbered as they are stored, so the numbers stay
    classes = stored(by_set.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    lists = stored(index_lists(classes, least), "ngram-lists")

    members = lists.select("node").distinct().join(classes.select("node", "one"), "node").select("node", F.col("one.doc_id").alias("n_id"), F.col("one.text_key").alias("n_key"))
    texts = stored(packed(docs).join(members, same_text("n")).select("node", "packed").dropDuplicates(["node"]), "ngram-texts")

    pairs = stored(lists.where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v"), F.shiftright("place", 32).alias("nv")).distinct(), "ngram-pairs")
    links = stored(compare(pairs, texts, n, least), "ngram-links")
    groups = stored(components(links), "ngram-groups")

    more = stored(open_pairs(lists, pairs, groups, least), "ngram-open")
    if more.take(1):
        groups = stored(components(links.unionByName(compare(more, texts, n, least))), "ngram-groups")

    named = classes.select("node", "set_key", F.col("one.doc_id").alias("smallest")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    answers = named.join(least_id, "component").select("set_key", "component_id", "component")
    return read_sets(docs, n).select("doc_id", "text_key", "set_key", F.col("n").alias("n_shingles")).join(answers, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component"
    )


def one_of_each(docs: DataFrame, n: int = 4, least: int = 85) -> DataFrame:
    """``docs`` with one row of each component: the smallest id's, then the smallest text key's.
    Rows with empty sets all stay."""
    found = join(docs, n, least)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one")
    kept = found.where("component is not null").groupBy("component").agg(first).select("one.doc_id", "one.text_key")
    alone = found.where("component is null").select("doc_id", "text_key").distinct()
    names = kept.unionByName(alone).select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"))

    def start():
        return lambda texts: [(text_key((t or "").encode()),) for t in texts]

    met = add_columns(docs, "text", start, "text_key long").join(names, same_text("k"), "left_semi")
    same = Window.partitionBy("doc_id", "text_key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return met.withColumn("_again", F.row_number().over(same)).where((F.col("_again") == 1) | empty).select(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir, "text")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLE: dict[str, str] = {}
