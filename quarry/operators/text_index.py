"""A stored BM25 index: posting blocks with block maxima, segments, deletion marks.

Tables of a version (``quarry.sources.versions``):

- ``postings`` (segment, term, block, n, max_tf, min_dl, entries): a term's documents in
  blocks of at most ``block_rows``, documents of like weight together, so that most
  blocks of a frequent term have a low maximum.
- ``docs`` (segment, node_id, dl, tf): each document's length and term counts.
- ``dead`` (segment, node_id): documents a later segment replaced or a call deleted.
- ``minus`` (term, df): what the dead documents still count for in ``postings``.

The number of live documents and their total length are values of the version.

``build`` publishes one segment in place of all before it; ``upsert`` adds a segment
with the changed documents, marks and subtracts their old versions; ``merge`` rewrites
the live documents as one segment, without tokenizing again.  Scores are those of an
index built anew over the live documents: document frequencies, count and mean length
are taken over all segments at query time, and nothing of them is stored in a weight.

``topk`` is exact and skips blocks.  A block's greatest term frequency and least length
bound the weight of its documents.  With ``theta``, a score that k documents of a query
reach for certain, a document below it cannot be a hit:

1. ``theta``: the first blocks of a query's strongest terms name a few documents, whose
   whole scores are taken from ``docs``; the k-th best is ``theta``.
2. Terms in falling order of their maximum: those at the end whose maxima together stay
   below a share of ``theta`` cannot make a hit on their own and are not read.
3. Of the other terms a block is read only if its bound plus the other terms' maxima
   reaches ``theta``; documents whose sum plus the unread terms' maxima does, get their
   whole score from ``docs``.

Duplicate ids within one call: the longest text wins, equal lengths by content hash.
A null text is a document without words; a null id is an error of the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.bm25 import B, K1, PRUNE_MARGIN, idf_expr, query_terms, tokens_of
from quarry.operators.topk import rank_by_score, store, top_k
from quarry.sources.versions import Snapshot, Versions

BLOCK_ROWS = 512
#: Per query: strongest terms whose first blocks are looked at, and documents taken from them per wanted hit.
FIRST_TERMS, FIRST_DOCS = 4, 4
#: The unread terms' maxima may sum up to this share of theta: a larger share reads less and leaves more documents to look up.
UNREAD_SHARE = 0.25


def counted(docs: DataFrame, segment: int, node_id: str, text: str, stopwords: list[str]) -> DataFrame:
    """``docs`` rows of a segment from texts: one row per id; stop words are not words."""
    rows = docs.select(F.col(node_id).alias("node_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.length("text"))
    once = top_k(rows, ["node_id"], [F.desc("_n"), F.asc("_h")], 1, "_r")
    tokens = tokens_of("text")
    words = once.select("node_id", (F.filter(tokens, lambda w: ~w.isin(stopwords)) if stopwords else tokens).alias("t"))
    node = words.schema["node_id"].dataType.simpleString()

    def count(batches) -> Iterator:
        """A document's terms are bounded by its own text: they are counted in its row, and no word is exchanged."""
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            dl = lists.value_lengths().to_numpy(zero_copy_only=False)
            encoded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(dl)), dl)
            terms = max(1, len(encoded.dictionary))
            found, n = np.unique(row * terms + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(found, np.arange(len(dl) + 1) * terms)
            tf = pa.StructArray.from_arrays([encoded.dictionary.take(pa.array(found % terms)), pa.array(n, pa.int32())], names=["term", "n"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tf)], names=["node_id", "dl", "tf"])

    listed = words.mapInArrow(count, f"node_id {node}, dl int, tf array<struct<term:string,n:int>>")
    return listed.select(F.lit(segment).alias("segment"), "node_id", "dl", "tf")


def blocks(docs: DataFrame, block_rows: int) -> DataFrame:
    """``postings`` of ``docs`` rows.

    Sorted by term and weight over ranges, so a term in most documents is spread over
    many tasks; runs of a term are cut into blocks as they stream by.
    """
    mean = docs.agg(F.avg("dl")).first()[0] or 1.0
    rows = docs.select("segment", F.explode("tf").alias("t"), "node_id", "dl").select("segment", F.col("t.term").alias("term"), "node_id", F.col("t.n").alias("tf"), "dl")
    # orders documents by weight at the present mean length; blocks stay valid for any other
    weight = F.col("tf") / (F.col("tf") + F.lit(K1 * (1 - B)) + F.lit(K1 * B / mean) * F.col("dl"))
    # range boundaries are drawn from a sample of the rows: compute them once
    sorted_rows = store(rows.withColumn("w", weight), "postings").repartitionByRange("segment", "term", F.desc("w"), "node_id").sortWithinPartitions("segment", "term", F.desc("w"), "node_id").drop("w")
    node = sorted_rows.schema["node_id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            segment, term = b.column(0), b.column(1)
            new = np.ones(len(term), bool)
            new[1:] = (term.dictionary_encode().indices.to_numpy(zero_copy_only=False)[1:] != term.dictionary_encode().indices.to_numpy(zero_copy_only=False)[:-1]) | (np.diff(segment.to_numpy()) != 0)
            starts = np.flatnonzero(new)
            within = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
            starts = np.flatnonzero(within % block_rows == 0)
            ends = np.append(starts[1:], len(term))
            tf, dl = b.column(3).to_numpy(), b.column(4).to_numpy()
            entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)), pa.int32()), pa.StructArray.from_arrays([b.column(2), b.column(3), b.column(4)], names=["node_id", "tf", "dl"]))
            columns = [segment.take(pa.array(starts)), term.take(pa.array(starts)), pa.array(ends - starts, pa.int32()), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), entries]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "max_tf", "min_dl", "entries"])

    cut = sorted_rows.mapInArrow(run, f"segment int, term string, n int, max_tf int, min_dl int, entries array<struct<node_id:{node},tf:int,dl:int>>")
    # a term's blocks differ in their first document
    return cut.withColumn("block", F.xxhash64("segment", "term", F.col("entries")[0]["node_id"]))


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents, sum of their lengths)."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    return r.n, r.length


@dataclass
class TextIndex:
    """An opened version; what is published later does not change it."""

    spark: SparkSession
    snapshot: Snapshot

    @property
    def n_docs(self) -> int:
        return self.snapshot.values["n_docs"]

    @property
    def avgdl(self) -> float:
        return self.snapshot.values["length"] / self.n_docs if self.n_docs else 0.0

    def table(self, name: str) -> DataFrame:
        return self.snapshot.read(self.spark, name)

    def live_docs(self) -> DataFrame:
        docs = self.table("docs")
        return docs.join(self.table("dead"), ["segment", "node_id"], "left_anti") if self.snapshot.values["n_dead"] else docs


def open_index(spark: SparkSession, root: str, version: int | None = None) -> TextIndex:
    snapshot = Versions(spark, root).open(version)
    if "postings" not in snapshot.tables:
        raise LookupError(f"no index below {root}")
    return TextIndex(spark, snapshot)


def _published(store_: Versions, base: Snapshot, docs_written, block_rows: int, segment: int, extra: dict) -> Snapshot:
    """One segment in place of everything in ``base``."""
    spark = store_.spark
    docs = Snapshot(0, {"docs": docs_written}).read(spark, "docs")
    n, length = totals(docs)
    node = docs.schema["node_id"].dataType.simpleString()
    none = lambda ddl: (spark.createDataFrame([], ddl).schema.json(), ())
    tables = {"docs": docs_written, "postings": store_.write("postings", blocks(docs, block_rows)), "dead": none(f"segment int, node_id {node}"), "minus": none("term string, df long")}
    return store_.publish(base, tables, {"n_docs": n, "length": length, "n_dead": 0, "segment": segment, "block_rows": block_rows, **extra})


def build(docs: DataFrame, root: str, *, node_id: str = "node_id", text: str = "text", block_rows: int = BLOCK_ROWS, stopwords: list[str] | None = None) -> TextIndex:
    """An index of ``docs`` in place of what ``root`` held.  ``stopwords`` leave documents and queries."""
    versions = Versions(docs.sparkSession, root)
    base = versions.open()
    segment = base.values.get("segment", 0) + 1
    written = versions.write("docs", counted(docs, segment, node_id, text, stopwords or []))
    return TextIndex(docs.sparkSession, _published(versions, base, written, block_rows, segment, {"stopwords": stopwords or []}))


def upsert(root: str, changed: DataFrame, deleted: DataFrame | None = None, *, node_id: str = "node_id", text: str = "text") -> TextIndex:
    """``changed`` documents replace or join the index, ids in ``deleted`` leave it.  An id in both is replaced.

    Writes a segment of the changed documents; stored segments are only read, and only
    the old versions' rows of them.
    """
    spark = changed.sparkSession
    versions = Versions(spark, root)
    base = versions.open()
    index = TextIndex(spark, base)
    segment = base.values["segment"] + 1
    written = versions.write("docs", counted(changed, segment, node_id, text, base.values["stopwords"]))
    fresh = Snapshot(0, {"docs": written}).read(spark, "docs")
    ids = fresh.select("node_id")
    if deleted is not None:
        ids = ids.unionByName(deleted.select(F.col(node_id).cast(fresh.schema["node_id"].dataType).alias("node_id"))).distinct()
    gone = store(index.live_docs().join(ids, "node_id", "left_semi"), "index-gone")
    n_gone, length_gone = totals(gone)
    n, length = totals(fresh)
    minus = gone.select(F.explode("tf.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tables = {"docs": versions.appended(base, "docs", written)}
    if n:
        tables["postings"] = versions.appended(base, "postings", versions.write("postings", blocks(fresh, base.values["block_rows"])))
    if n_gone:
        tables["dead"] = versions.appended(base, "dead", versions.write("dead", gone.select("segment", "node_id")))
        tables["minus"] = versions.appended(base, "minus", versions.write("minus", minus))
    values = base.values
    new = {"n_docs": values["n_docs"] + n - n_gone, "length": values["length"] + length - length_gone, "n_dead": values["n_dead"] + n_gone, "segment": segment}
    return TextIndex(spark, versions.publish(base, tables, new))


def merge(spark: SparkSession, root: str) -> TextIndex:
    """The live documents as one segment."""
    versions = Versions(spark, root)
    base = versions.open()
    segment = base.values["segment"] + 1
    live = TextIndex(spark, base).live_docs().withColumn("segment", F.lit(segment))
    return TextIndex(spark, _published(versions, base, versions.write("docs", live), base.values["block_rows"], segment, {}))


@dataclass
class Weights:
    """The BM25 weight of a posting as column expressions, for one version."""

    index: TextIndex
    k1: float
    b: float
    plus_one: bool

    def part(self, tf: str, dl: str) -> Column:
        """What a document with this term frequency and length multiplies idf with; grows with tf, falls with dl."""
        per_word = self.k1 * self.b / self.index.avgdl if self.index.avgdl else 0.0
        return F.col(tf) * F.lit(self.k1 + 1.0 if self.plus_one else 1.0) / (F.col(tf) + F.lit(self.k1 * (1.0 - self.b)) + F.lit(per_word) * F.col(dl))


def whole_scores(pairs: DataFrame, index: TextIndex, qside: DataFrame, weights: Weights) -> DataFrame:
    """(query_id, node_id, score) of given (query_id, node_id) pairs, from the documents' own term counts."""
    words = pairs.join(index.live_docs(), "node_id").select("query_id", "node_id", "dl", F.explode("tf").alias("t"))
    terms = words.select("query_id", "node_id", "dl", F.col("t.term").alias("term"), F.col("t.n").alias("tf"))
    scored = terms.join(qside.select("query_id", "term", "qw"), ["query_id", "term"])
    return scored.groupBy("query_id", "node_id").agg(F.sum(F.col("qw") * weights.part("tf", "dl")).alias("score"))


def query_side(queries: DataFrame, index: TextIndex, weights: Weights, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qw, most): weight of a term in a query, and the most it can add to a score."""
    wanted = query_terms(queries, query_id, text, index.snapshot.values["stopwords"])
    vocabulary = wanted.select("term").distinct()
    heads = index.table("postings").select("term", "n", "max_tf", "min_dl").join(vocabulary, "term", "left_semi")
    terms = heads.groupBy("term").agg(F.sum("n").alias("n"), F.max(weights.part("max_tf", "min_dl")).alias("part"))
    if index.snapshot.values["n_dead"]:
        less = index.table("minus").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("less"))
        terms = terms.join(less, "term", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    terms = terms.where(F.col("n") > 0).select("term", idf_expr(F.lit(float(index.n_docs)), "n").alias("idf"), "part")
    side = wanted.join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qw"), "part")
    return store(side.withColumn("most", F.col("qw") * F.col("part")).drop("part"), "index-query-side")


def block_heads(index: TextIndex, qside: DataFrame, weights: Weights) -> DataFrame:
    """(segment, term, n, max_tf, min_dl, block, part): the blocks of the queries' terms, without their entries."""
    vocabulary = qside.select("term").distinct()
    heads = index.table("postings").select("segment", "term", "n", "max_tf", "min_dl", "block")
    return store(heads.join(vocabulary, "term", "left_semi").withColumn("part", weights.part("max_tf", "min_dl")), "index-heads")


def topk(
    queries: DataFrame, index: TextIndex, k: int = 5, *, query_id: str = "query_id", text: str = "text",
    k1: float = K1, b: float = B, plus_one: bool = True,
) -> DataFrame:
    """B6 over the stored index: exact, same rows as ``bm25.bm25_topk`` -> (query_id, node_id, score, rank)."""
    return search(queries, index, k, query_id=query_id, text=text, k1=k1, b=b, plus_one=plus_one)[0]


def search(
    queries: DataFrame, index: TextIndex, k: int, *, query_id: str = "query_id", text: str = "text", k1: float = K1, b: float = B, plus_one: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(hits, read): the top k and the (query_id, term, block, n) whose entries were scored for them."""
    weights = Weights(index, k1, b, plus_one)
    qside = query_side(queries, index, weights, query_id, text)
    heads = block_heads(index, qside, weights)
    postings = index.table("postings").select("term", "segment", "block", "entries")

    def entries_of(chosen: DataFrame) -> DataFrame:
        """(query_id, node_id, w): the postings of chosen (query_id, term, qw, block)."""
        rows = postings.join(chosen, ["term", "block"]).select("query_id", "qw", "segment", F.explode("entries").alias("e"))
        rows = rows.select("query_id", "segment", F.col("e.node_id").alias("node_id"), (F.col("qw") * weights.part("e.tf", "e.dl")).alias("w"))
        return rows.join(index.table("dead"), ["segment", "node_id"], "left_anti") if index.snapshot.values["n_dead"] else rows

    # 1. theta from a few likely documents
    strongest = top_k(qside, ["query_id"], [F.desc("most"), F.asc("term")], FIRST_TERMS, "_t")
    first_block = top_k(heads, ["term"], [F.desc("part"), F.asc("block")], 1, "_b").select("term", "block")
    likely = entries_of(strongest.join(first_block, "term").select("query_id", "term", "qw", "block"))
    likely = rank_by_score(likely.groupBy("query_id", "node_id").agg(F.sum("w").alias("score")), ["query_id"], FIRST_DOCS * k)
    sure = whole_scores(likely.select("query_id", "node_id"), index, qside, weights)
    kth = rank_by_score(sure, ["query_id"], k).where(F.col("rank") == k).select("query_id", (F.col("score") - F.lit(PRUNE_MARGIN)).alias("theta"))

    # 2. the terms whose maxima, summed from the least up, stay below theta are not read
    up = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    all_terms = Window.partitionBy("query_id")
    ranked = qside.withColumn("upto", F.sum("most").over(up)).withColumn("total", F.sum("most").over(all_terms)).join(kth, "query_id", "left")
    ranked = ranked.withColumn("theta", F.coalesce("theta", F.lit(0.0))).withColumn("read", F.col("upto") >= F.col("theta") * F.lit(UNREAD_SHARE))
    ranked = store(ranked.withColumn("unread", F.coalesce(F.max(F.when(~F.col("read"), F.col("upto"))).over(all_terms), F.lit(0.0))), "index-terms")

    # 3. blocks that can hold a hit
    others = F.col("total") - F.col("most")
    chosen = ranked.where("read").join(heads.select("term", "block", "part", "n"), "term").where(F.col("qw") * F.col("part") + others >= F.col("theta") - F.lit(PRUNE_MARGIN))
    read = chosen.select("query_id", "term", "qw", "block", "n")
    limits = ranked.groupBy("query_id").agg(F.max("theta").alias("theta"), F.max("unread").alias("unread"), F.max((~F.col("read")).cast("int")).alias("some_unread"))
    sums = entries_of(read.drop("n")).groupBy("query_id", "node_id").agg(F.sum("w").alias("score"))
    sums = store(sums.join(limits, "query_id").where(F.col("score") + F.col("unread") >= F.col("theta") - F.lit(PRUNE_MARGIN)), "index-sums")
    done = sums.where("some_unread = 0").select("query_id", "node_id", "score")
    # the k best sums so far say more than theta: fewer whole scores to take
    open_ = sums.where("some_unread = 1")
    least = rank_by_score(open_.select("query_id", "node_id", "score"), ["query_id"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = open_.join(least, "query_id", "left").where(F.col("score") + F.col("unread") >= F.coalesce("least", F.lit(0.0)) - F.lit(PRUNE_MARGIN))
    whole = whole_scores(open_.select("query_id", "node_id"), index, qside, weights)
    return rank_by_score(done.unionByName(whole).where("score > 0"), ["query_id"], k), read
