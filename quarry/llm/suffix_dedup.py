"""Exact removal of long repeated byte strings, by the interval trees of enhanced suffix arrays.

Sorting all suffixes of a corpus would move every byte hundreds of times.  Only
suffixes that can start a repeat are sorted:

1. ``anchors``: in every window of ``length`` bytes the ``gram``-byte strings of
   smallest hash are anchors.  Equal windows have equal anchors at equal places,
   so a repeated window always shows as one anchor string in two places.  A
   window's other bytes lie at most ``slack = length - gram`` to its anchor's
   left or right; that much is the anchor's context.
2. Anchors whose string occurs once are dropped by counting hashes.  Equal
   anchors with equal contexts form a class; one of each class goes on.
3. Per anchor string, the suffixes behind it are sorted (Spark sorts them inside
   the partitions), which gives a suffix array; the common prefixes of
   neighbours are its LCP array, and a scan with a stack lists its LCP
   intervals, the nodes of the common-prefix tree.  All members of an interval
   share ``r`` bytes to the right.  Inside it the left contexts are compared in
   sorted order: neighbours that share at least ``slack - r`` bytes belong to one
   repeat of ``length`` bytes or more, and where they cease to agree the left
   extension is diverse, which ends the repeat.  Each such group is a maximal
   repeat with all its occurrences (``repeats``).
4. Anchor strings with more than ``most`` distinct contexts (a passage in a third
   of all texts, met in different surroundings) are not gathered in one task.
   Their windows are halved by offset, and what a half shares beside the anchor
   tells them apart, until at most ``most`` contexts share it: these go through
   the tree with the longer string in the anchor's place (``split_hot``).  A
   repeat is then listed as far as it lies in one half's surroundings.
5. Every occurrence is covered as far as its class's repeats reach; the covered
   bytes of a text are merged and removed (``remove_repeats``).

Texts travel compressed, once to cut the contexts and once to be rewritten.

Defined cases: null text is empty; matches never cross texts; texts shorter than
``length`` bytes keep everything; repeated rows (same id and text) are occurrences
of each other and each give a row; null ids are texts like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, map_rows, packed, same_text, stored, text_key


@dataclass(frozen=True)
class Shape:
    length: int = 400
    gram: int = 240
    most: int = 1000  # distinct contexts of one anchor string that a task may hold

    @property
    def slack(self) -> int:
        return self.length - self.gram


# ---------------------------------------------------------------- anchors

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of a long text hashed at once.
PIECE = 1 << 20


class Powers:
    """BASE ** i and its inverse, as far as needed."""

    def __init__(self):
        self.up, self.down = self.of(BASE, 1 << 12), self.of(BASE_INVERSE, 1 << 12)

    @staticmethod
    def of(base: np.uint64, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self.of(BASE, 2 * n), self.of(BASE_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes at each place, from one running sum."""
    up, down = powers.first(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, best: np.ufunc, neutral) -> np.ndarray:
    """best(values[i : i + width]) for each i, in two scans over blocks of ``width``."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, neutral, values.dtype))).reshape(-1, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, shape: Shape, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are smallest in some window of ``length`` bytes."""
    places, hashes = [], []
    width, step = shape.slack + 1, PIECE
    for start in range(0, max(len(data) - shape.length, 0) + 1, step):
        part = data[max(start - shape.slack, 0) : start + step + 2 * shape.length]
        if len(part) < shape.length:
            break
        h = gram_hashes(part, shape.gram, powers)
        least = sliding(h, width, np.minimum, np.uint64(2**64 - 1))  # of each window
        edge = np.zeros(width - 1, np.uint64)
        reached = sliding(np.concatenate((edge, least, edge)), width, np.maximum, np.uint64(0))  # of the windows that hold the gram
        at = np.flatnonzero(h == reached)
        places.append(at + max(start - shape.slack, 0))
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


ANCHORS = "gram long, context long, doc_id long, text_key long, at long, before int, after int"


def anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """One row per anchor: hash of its string, hash of its context, place, and the bytes of context on either side."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                if len(data) < shape.length:
                    continue
                place, h = anchors_of(np.frombuffer(data, np.uint8), shape, powers)
                before = np.minimum(place, shape.slack)
                after = np.minimum(len(data) - shape.gram - place, shape.slack)
                context = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], s) for a, b, s in zip((place - before).tolist(), (place + shape.gram + after).tolist(), before.tolist())), np.uint64, len(place))
                n = len(place)
                columns = [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, text_key(data))), pa.array(place), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "doc_id", "text_key", "at", "before", "after"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ANCHORS)


# ---------------------------------------------------------------- interval trees


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] agrees, a[: hi + 1] does not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the LCP intervals, deepest first; lcp[i] is that of suffixes i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and here < stack[-1][0]:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if not stack or here > stack[-1][0]:
            stack.append((here, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], slack: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(right depth, shared left, [(member, its left reach)]) of the repeats of one anchor string.

    ``rights`` are sorted; ``lefts`` are reversed, nearest byte first.  A repeat's
    members share ``depth`` bytes to the right and ``shared`` to the left, and
    depth + shared >= slack.
    """
    n = len(rights)
    lcp = [0] + [common(rights[i - 1], rights[i]) for i in range(1, n)]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    for depth, first, last in intervals(lcp):
        least = slack - depth
        members = sorted(range(first, last + 1), key=rank.__getitem__) if last - first < n - 1 else order
        shared = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        start = 0
        for k in range(len(members)):
            # the left extension turns diverse after member k, or the interval ends
            if k == len(shared) or shared[k] < least:
                if k > start:
                    inner = shared[start:k]
                    reach = [max(inner[max(j - 1, 0) : j + 1]) for j in range(k - start + 1)]
                    yield depth, min(inner), list(zip(members[start : k + 1], reach))
                start = k + 1


REPEATS = "repeat_id long, length int, gram long, context long, left int, right int"


def tree_repeats(contexts: DataFrame, shape: Shape) -> DataFrame:
    """The maximal repeats among the contexts of each ``core``, of at most ``most`` rows: one row
    per repeat and class, with how far the class's occurrences agree to either side of the anchor."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        rows = (r for b in batches for r in zip(*(b[c] for c in ("core", "gram", "context", "lefts", "rights"))))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            members = [next(g) for _, g in groupby(group, key=lambda r: (r[2], r[4]))]  # one of equal rows
            lefts, rights = [m[3] for m in members], [m[4] for m in members]
            for depth, shared, found in maximal_repeats(lefts, rights, shape.slack):
                one = found[0][0]
                gram = members[one][1]
                name = xxhash.xxh3_64_intdigest(b"%d|" % gram + lefts[one][:shared] + b"|" + rights[one][:depth]) - (1 << 63)
                out += [(name, shape.gram + depth + shared, gram, members[i][2], reach, depth) for i, reach in found]
            if len(out) > 50_000:
                yield out
                out = []
        yield out

    return map_rows(contexts.select("core", "gram", "context", "lefts", "rights").repartition("core").sortWithinPartitions("core", "rights", "context"), run, REPEATS)


# ---------------------------------------------------------------- hot anchor strings


def halves(rows: DataFrame, shape: Shape) -> DataFrame:
    """Each row (gram, context, lefts, rights, a, b) once per half of its offsets a..b in which its text
    holds a window, cut to the half's surroundings, with the hashes of core and surroundings."""
    slack = shape.slack

    def run(batches: Iterator[dict]) -> Iterator[list]:
        for batch in batches:
            out = []
            for gram, context, left, right, first, last in zip(*(batch[c] for c in ("gram", "context", "lefts", "rights", "a", "b"))):
                middle = (first + last) // 2
                for a, b in ((first, middle), (middle + 1, last)):
                    if max(a, slack - len(right)) <= min(b, len(left)):
                        core = xxhash.xxh3_64_intdigest(b"%d|%d|" % (gram, a) + left[:a] + b"|" + right[: slack - b])
                        l, r = left[:b], right[: slack - a]
                        out.append((gram, context, l, r, a, b, core - (1 << 63), xxhash.xxh3_64_intdigest(l + b"|" + r, len(l)) - (1 << 63)))
            yield out

    return map_rows(rows, run, "gram long, context long, lefts binary, rights binary, a int, b int, core long, around long")


def split_hot(contexts: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """(known, cores) for anchor strings with too many contexts for one task: repeats that counting
    shows, and rows for ``tree_repeats`` with at most ``most`` contexts to a core.

    A window is an offset o: o bytes left of the anchor and slack - o right of it.
    The windows of the offsets a..b share a core, the anchor with a bytes left and
    slack - b right, and lie in surroundings of b bytes left and slack - a right.
    Each level halves the ranges, so cores grow and surroundings shrink.  Equal
    surroundings are repeats; one of each goes on, so that nothing loses its partner.
    A core with one surroundings is done, one with at most ``most`` goes to the tree
    with the core in the anchor's place, and the others are halved again.  At a
    single offset core and surroundings are the same, so all end.
    """
    rows = contexts.select("gram", "context", "lefts", "rights", F.lit(0).alias("a"), F.lit(shape.slack).alias("b"))
    known, small = [], []
    for _ in range(shape.slack.bit_length()):
        parts = stored(halves(rows, shape), "suffix-split")
        # the small sides of the joins below come from tables, so that a hot core can be split
        same = stored(parts.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("gram", "context")).alias("one")), "suffix-arounds")
        cores = stored(same.groupBy("core").agg(F.count("*").alias("arounds")).where("arounds > 1"), "suffix-cores")
        known.append(
            parts.join(same.where("n > 1").select("core", "around"), ["core", "around"]).select(
                F.xxhash64("core", "around").alias("repeat_id"), (F.length("lefts") + F.length("rights") + shape.gram).alias("length"), "gram", "context", F.length("lefts").alias("left"), F.length("rights").alias("right")
            )
        )
        ones = same.select("core", "around", "one.gram", "one.context").join(cores, "core")
        open_rows = stored(parts.join(ones, ["core", "around", "gram", "context"]).select("core", "gram", "context", "lefts", "rights", "a", "b", (F.col("arounds") > shape.most).alias("hot")), "suffix-open")
        small.append(open_rows.where("not hot").select("core", "gram", "context", "lefts", "rights"))
        rows = open_rows.where("hot")
        if not rows.take(1):
            break
    return reduce(DataFrame.unionByName, known), reduce(DataFrame.unionByName, small)


# ---------------------------------------------------------------- texts


def cut_contexts(docs: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """(gram, context, hot, lefts, rights) for ``wanted`` (doc_id, text_key, at, gram, context, hot)."""
    places = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).agg(F.collect_list(F.struct("at", "gram", "context", "hot")).alias("places"))

    def run(batches: Iterator[dict]) -> Iterator[list]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, places in zip(b["packed"], b["places"]):
                data = unpacker.decompress(z)
                for p in places:
                    at, end = p["at"], p["at"] + shape.gram
                    out.append((p["gram"], p["context"], p["hot"], data[max(at - shape.slack, 0) : at][::-1], data[end : end + shape.slack]))
                if len(out) > 50_000:
                    yield out
                    out = []
            yield out

    met = packed(docs).join(places, same_text("w")).select("packed", "places")
    return map_rows(met, run, "gram long, context long, hot boolean, lefts binary, rights binary")


def find_anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """The anchors whose string occurs more than once; stored.

    Here and below the small side of a join on anchor strings is stored first: both
    sides are then plain exchanges, and Spark can split a string that a third of
    all anchors share.
    """
    every = stored(anchors(docs, shape), "suffix-anchors")
    repeated = stored(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-strings")
    return stored(every.join(repeated, "gram"), "suffix-repeated")


def repeats(docs: DataFrame, found: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(repeat_id, length, gram, context, left, right): the maximal repeats of at least ``length``
    bytes.  The occurrences of one are all rows of ``found`` of its (gram, context) classes, each from
    ``at - left`` to ``at + gram + right``."""
    place = F.min(F.struct("doc_id", "text_key", "at")).alias("p")
    classes = stored(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"), place), "suffix-classes")
    both = F.col("before") + F.col("after")
    copies = classes.where((F.col("n") > 1) & (both >= shape.slack)).select(
        F.xxhash64("gram", "context").alias("repeat_id"), (both + shape.gram).alias("length"), "gram", "context", F.col("before").alias("left"), F.col("after").alias("right")
    )
    several = stored(classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1"), "suffix-several")
    wanted = classes.join(several, "gram").select("p.doc_id", "p.text_key", "p.at", "gram", "context", (F.col("classes") > shape.most).alias("hot"))
    contexts = stored(cut_contexts(docs, wanted, shape), "suffix-contexts")
    whole = contexts.where("not hot").select(F.col("gram").alias("core"), "gram", "context", "lefts", "rights")
    hot = contexts.where("hot")
    if not hot.take(1):
        return copies.unionByName(tree_repeats(whole, shape))
    known, cores = split_hot(hot, shape)
    return copies.unionByName(known).unionByName(tree_repeats(whole.unionByName(cores), shape))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the removed byte ranges, and the remaining bytes."""
    found = find_anchors(docs, shape)
    reach = stored(repeats(docs, found, shape).groupBy("gram", "context").agg(F.max("left").alias("left"), F.max("right").alias("right")), "suffix-reach")
    covered = found.join(reach, ["gram", "context"]).select("doc_id", "text_key", F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + shape.gram + F.col("right")).alias("end")).alias("span"))
    spans = covered.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).agg(F.collect_set("span").alias("spans"))

    def run(batches: Iterator[dict]) -> Iterator[list]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc_id, z, spans in zip(b["doc_id"], b["packed"], b["spans"]):
                data = unpacker.decompress(z)
                cut = merged([(s["start"], s["end"]) for s in spans or ()])
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)]))
                out.append((doc_id, len(data), [x for span in cut for x in span], kept))
            yield out

    return map_rows(packed(docs).join(spans, same_text("c"), "left").select("doc_id", "packed", "spans"), run, "doc_id long, n_bytes long, spans array<long>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "text")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE: dict[str, str] = {}
