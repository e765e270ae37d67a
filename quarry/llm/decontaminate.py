"""Benchmark decontamination with spaced-seed hashing.

A mask such as ``1110111`` hashes the tokens at its 1s and ignores the others, so
a passage with substituted tokens still agrees with the benchmark wherever the
substitutions fall on the 0s of one of the masks.

1. Benchmark items (equal ones are searched once, under their smallest item id, and
   named by ``equal_items``) become
   passages of at most ``PASSAGE`` tokens; those of a longer item overlap, and
   its tokens stay together in stretches of at most ``STRETCH``, which overlap too.
2. The stretches go to every task in blocks of about ``block_tokens`` (a fixed
   bound; a larger benchmark means more blocks, not larger ones): per mask the
   sorted hashes of all positions in their passages.
3. Each text's windows are hashed with the same masks and looked up, all texts of
   a batch at once.  A hit fixes a diagonal; along it the tokens are compared and
   the best run with at least 2 equal tokens per substitution is taken.
4. A text holds an item if that run has ``ENOUGH`` equal tokens or half of the
   item's, whichever is less, and at least ``MIN_TOKENS``.  In a longer item the
   run is then taken along the diagonal of the whole stretch.

Texts never move: the result is an array column ``leaks`` on each row.

Tokens are lower-cased runs of characters other than ASCII blanks, controls and
punctuation.  Passages shorter than the widest mask also have an exact seed over
all their tokens, so an item of a few tokens, or one, is found where it is verbatim.

Defined cases: null or empty text has no leaks; null, empty or token-less items
match nothing; a null item id is kept as null; ties between runs go to the first
position; repeated rows each get the same answer; without benchmark rows every
array is empty; an empty table gives an empty result; other columns pass through,
a column of the name ``leaks`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import add_columns, documents, map_rows, stored
from quarry.sources.tables import table

MASKS = ("1110111", "11011011", "1111011", "110101011")
PASSAGE, STRETCH, OVERLAP = 256, 1 << 15, 64
MIN_TOKENS, ENOUGH = 8, 13
PENALTY = 2
BLOCK_TOKENS = 250_000
#: Tokens of texts hashed at once, and hits verified at once.
BATCH_TOKENS, BATCH_HITS = 1 << 20, 1 << 18
FILTER_BITS = 22
LEAKS = "array<struct<item_id:long,start:int,length:int,matched:int,passage_tokens:int>>"

_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_BLANKED = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8").translate(_BLANKED).split() if text else []


class TokenNumbers(dict):
    """token -> 64-bit number; a memo that is emptied when it grows large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        number = self[token] = xxhash.xxh3_64_intdigest(token)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def least_equal(item_tokens: int) -> int:
    """Equal tokens that a run needs in an item of so many tokens."""
    return min(ENOUGH, max(min(MIN_TOKENS, item_tokens), -(-item_tokens // 2)))


def overlapping(n: int, size: int) -> list[tuple[int, int]]:
    """(start, end) of parts of at most ``size``; every ``OVERLAP`` neighbours share a part."""
    return [(a, min(a + size, n)) for a in range(0, max(n - OVERLAP, 1), size - OVERLAP)]


def window_hashes(numbers: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked tokens at each window start."""
    n = len(numbers) - len(mask) + 1
    h = np.zeros(max(n, 0), np.uint64)
    for offset, bit in enumerate(mask):
        if bit == "1" and n > 0:
            h = (h + numbers[offset : offset + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Seeds:
    """The positions of a block's passages by masked hash."""

    def __init__(self, stretches: list[tuple], masks: tuple[str, ...] = MASKS):
        """stretches: (item_id, tokens of the whole item, [token numbers])."""
        self.stretches = [(item, n, np.array(numbers, np.uint64)) for item, n, numbers in stretches]
        self.passages = [(k, a, t[a:b]) for k, (_, _, t) in enumerate(self.stretches) for a, b in overlapping(len(t), PASSAGE)]
        widest = max(map(len, masks))
        lengths = {len(p) for _, _, p in self.passages if len(p) < widest}
        self.index = [self._index(m, False) for m in masks] + [self._index("1" * n, True) for n in sorted(lengths)]
        self.index = [x for x in self.index if len(x[1])]

    def _index(self, mask: str, whole: bool) -> tuple:
        hashes, owner, place = [], [], []
        for i, (_, _, p) in enumerate(self.passages):
            if len(p) == len(mask) or not whole:
                h = window_hashes(p, mask)
                hashes.append(h)
                owner.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        if not hashes:
            return mask, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, bool)
        h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        known = np.zeros(1 << FILTER_BITS, bool)
        known[h >> np.uint64(64 - FILTER_BITS)] = True
        return mask, h[order], o[order], p[order], known

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, diagonal = text position - passage position) of every seed hit, in bounded parts."""
        for mask, hashes, owner, place, known in self.index:
            h = window_hashes(numbers, mask)
            at = np.flatnonzero(known[h >> np.uint64(64 - FILTER_BITS)])
            first = np.searchsorted(hashes, h[at], "left")
            n = np.searchsorted(hashes, h[at], "right") - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            cut = np.flatnonzero(np.diff(np.cumsum(n) // BATCH_HITS)) + 1
            for a, f, k in zip(np.split(at, cut), np.split(first, cut), np.split(n, cut)):
                if len(a):
                    entry = np.repeat(f - np.cumsum(k) + k, k) + np.arange(k.sum())
                    yield owner[entry], np.repeat(a, k) - place[entry]


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal tokens) of the run with the highest equal - PENALTY * unequal."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def find_leaks(texts: list[str | None], seeds: Seeds, numbers_of: TokenNumbers) -> list[list[tuple]]:
    """The leaks of each text: (item_id, start token, length, equal tokens, item tokens)."""
    out: list[list[tuple]] = []
    group: list[np.ndarray] = []
    room = 0
    for text in texts:
        group.append(numbers_of.of(tokens(text)))
        room += len(group[-1])
        if room > BATCH_TOKENS:
            out += scan_group(group, seeds)
            group, room = [], 0
    return out + scan_group(group, seeds)


def scan_group(group: list[np.ndarray], seeds: Seeds) -> list[list[tuple]]:
    found: list[dict] = [{} for _ in group]
    if group and seeds.index:
        edges = np.concatenate(([0], np.cumsum([len(g) for g in group])))
        numbers = np.concatenate(group)
        seen: set[tuple[int, int, int]] = set()
        for owner, diagonal in seeds.hits(numbers):
            # a window may straddle texts; the run is cut at the edges of the text its middle lies in
            pairs = np.unique(np.stack((owner, diagonal)), axis=1)
            for p, d in pairs.T.tolist():
                k, offset, passage = seeds.passages[p]
                item, item_tokens, stretch = seeds.stretches[k]
                least = least_equal(item_tokens)
                lo, hi = max(d, 0), min(d + len(passage), len(numbers))
                doc = int(np.searchsorted(edges, lo, "right")) - 1
                known = found[doc].get(item)
                if known and known[3] == item_tokens and hi <= edges[doc + 1]:
                    continue  # all of it was found, further to the front
                while doc < len(group) and edges[doc] < hi:
                    first, last = int(edges[doc]), int(edges[doc + 1])
                    a, b = max(lo, first), min(hi, last)
                    if b - a >= min(MIN_TOKENS, len(passage)) and not seen & {(doc, p, d), (doc, k, d - offset, "whole")}:
                        seen.add((doc, p, d))
                        start, length, matched = best_run(numbers[a:b] == passage[a - d : b - d])
                        if matched >= least and len(stretch) > len(passage):
                            seen.add((doc, k, d - offset, "whole"))
                            shift = d - offset
                            c, e = max(shift, first), min(shift + len(stretch), last)
                            longer = best_run(numbers[c:e] == stretch[c - shift : e - shift])
                            if longer[2] >= matched:
                                a, (start, length, matched) = c, longer
                        if matched >= least:
                            row = (item, a + start - first, length, matched, item_tokens)
                            old = found[doc].get(item)
                            if old is None or (-row[3], row[1]) < (-old[3], old[1]):
                                found[doc][item] = row
                    doc += 1
    return [sorted(f.values(), key=lambda r: (r[0] is not None, r[0], r[1])) for f in found]


def item_numbers(benchmark: DataFrame) -> DataFrame:
    """(item_id, numbers): items with a token, as token numbers."""

    def read(batches: Iterator[dict]) -> Iterator[list]:
        numbers_of = TokenNumbers()
        for b in batches:
            rows = ((item, numbers_of.of(tokens(text)).astype(np.int64)) for item, text in zip(b["item_id"], b["text"]))
            yield [(item, n.tolist()) for item, n in rows if len(n)]

    return map_rows(benchmark.select(F.col("item_id").cast("long"), "text"), read, "item_id long, numbers array<long>")


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, numbers): distinct items."""
    return item_numbers(benchmark).groupBy("numbers").agg(F.min("item_id").alias("item_id"))


def equal_items(benchmark: DataFrame) -> DataFrame:
    """(found_id, item_id): each item with the id under which ``with_leaks`` reports it."""
    named = item_numbers(benchmark).distinct()
    return named.join(distinct_items(benchmark).withColumnRenamed("item_id", "found_id"), "numbers").select("found_id", "item_id")


def stretches(items: DataFrame) -> DataFrame:
    """(item_id, item_tokens, offset, numbers): items in overlapping stretches of at most ``STRETCH`` tokens."""

    def cut(batches: Iterator[dict]) -> Iterator[list]:
        for b in batches:
            for item, n in zip(b["item_id"], b["numbers"]):
                yield [(item, len(n), start, n[start:end]) for start, end in overlapping(len(n), STRETCH)]

    return map_rows(items.select("item_id", "numbers"), cut, "item_id long, item_tokens int, offset long, numbers array<long>")


def best_of_each(leaks: Column) -> Column:
    """Of several entries of an item, from stretches in different blocks, the one that ``scan_group`` would keep."""
    rank = lambda x: F.struct(-x["matched"], x["start"])
    better = lambda y, j, x, i: y["item_id"].eqNullSafe(x["item_id"]) & ((rank(y) < rank(x)) | ((rank(y) == rank(x)) & (j < i)))
    numbered = F.transform(leaks, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda a: ~F.exists(numbered, lambda b: better(b["x"], b["i"], a["x"], a["i"])))
    return F.transform(kept, lambda a: a["x"])


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with an array column ``leaks``: one entry per benchmark item found in the text."""
    parts = stored(stretches(distinct_items(benchmark)), "benchmark-stretches")
    blocks = -(-(parts.agg(F.sum(F.size("numbers"))).first()[0] or 0) // block_tokens)
    docs = docs.withColumn("leaks", F.array().cast(LEAKS))
    for i in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("numbers"), F.lit(blocks)) == i).collect()  # at most about block_tokens numbers
        sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.item_tokens, np.array(r.numbers, np.int64).view(np.uint64)) for r in rows])
        docs = add_columns(docs, text, finder(sent), f"_found {LEAKS}").withColumn("leaks", F.concat("leaks", "_found")).drop("_found")
    return docs.withColumn("leaks", best_of_each(F.col("leaks"))) if blocks > 1 else docs


def finder(sent):
    def start():
        seeds, numbers_of = Seeds(sent.value), TokenNumbers()
        names = ("item_id", "start", "length", "matched", "passage_tokens")
        return lambda texts: [([dict(zip(names, r)) for r in leaks],) for leaks in find_leaks(texts, seeds, numbers_of)]

    return start


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (document, benchmark item) of which the document holds enough."""
    benchmark = table(spark, sf_dir, "benchmark")
    out = with_leaks(documents(spark, sf_dir, "text"), benchmark).select("doc_id", F.inline("leaks")).withColumnRenamed("item_id", "found_id")
    named = stored(equal_items(benchmark), "benchmark-names").withColumnRenamed("found_id", "_id")
    return out.join(named, F.col("found_id").eqNullSafe(F.col("_id"))).select("doc_id", "item_id", "start", "length", "matched", "passage_tokens")


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE: dict[str, str] = {}
