"""Chunking (T2, T3, T4): token windows and the three-tier chunk tree.

Token = word token of ``tokenize`` (T1); chunk text = its tokens joined by a
single space.  All work is per document row (higher-order functions over the
token array), so chunking never shuffles; chunk texts are built inside the
row and only then exploded, so no exploded row carries the whole array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokenize

# Ingestion splitter and default index splitter (size, overlap).
INGEST_CHUNK = (256, 20)
DEFAULT_CHUNK = (1024, 200)
# Fixed value: chunk sizes of the three-tier tree, largest first.
TREE_SIZES = (512, 256, 128)


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """Number of windows covering n tokens: 0 for n = 0, else 1 + ceil((n - size) / stride)."""
    stride = size - overlap
    return F.when(n == 0, F.lit(0)).otherwise(
        F.lit(1) + F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(stride)).cast("int"))
    )


def chunk_fixed(
    docs: DataFrame,
    size: int = INGEST_CHUNK[0],
    overlap: int = INGEST_CHUNK[1],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """T2(a)/T3: windows of ``size`` tokens advancing by ``size - overlap``.

    Output: (node_id = "<doc>/<chunk_no>", doc_id, chunk_no, text, n_tokens, *keep).
    """
    stride = size - overlap
    toks = docs.select(F.col(id_col).alias("doc_id"), *keep, tokenize(text_col).alias("_t"))
    toks = toks.withColumn("_n", n_windows(F.size("_t"), size, overlap))
    chunks = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.array_join(F.slice(F.col("_t"), i * stride + 1, F.lit(size)), " "),
    )
    out = toks.select(
        "doc_id", *keep,
        F.posexplode_outer(F.when(F.col("_n") > 0, chunks)).alias("chunk_no", "text"),
    ).filter(F.col("text").isNotNull())
    return out.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("node_id"),
        "doc_id",
        "chunk_no",
        "text",
        F.size(F.split("text", " ")).alias("n_tokens"),
        *keep,
    )


def chunk_tree(
    docs: DataFrame,
    sizes: Sequence[int] = TREE_SIZES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: bool = True,
) -> DataFrame:
    """T4: three-tier tree, every tier cut from its parent's span, no overlap.

    Node at level L (0 = root) with sequence number s covers tokens
    [s * size_L, (s + 1) * size_L).  Its parent at level L-1 has sequence
    s * size_L div size_{L-1}.  Ids spell the path: "<doc>/<root>/<mid>/<leaf>".
    Whether a node is a leaf, and how many children its parent has, are known
    when it is cut and come with it, so no later join has to find out.
    Output: (node_id, parent_id, doc_id, level, seq, text, n_tokens, is_leaf, siblings);
    without ``texts`` the same nodes less their text, which then is not cut.
    """
    sizes = list(sizes)
    toks = docs.select(F.col(id_col).alias("doc_id"), tokenize(text_col).alias("_t")).withColumn("_n", F.size("_t"))

    def path(s: Column, lvl: int, upto: int) -> Column:
        parts = [F.col("doc_id").cast("string")]
        for j in range(upto + 1):
            parts.append(F.floor(s * F.lit(sizes[lvl]) / F.lit(sizes[j])).cast("string"))
        return F.concat_ws("/", *parts)

    def siblings(s: Column, lvl: int) -> Column:
        """Children of the parent: the cuts of what its span holds."""
        parent = F.floor(s * F.lit(sizes[lvl]) / F.lit(sizes[lvl - 1]))
        held = F.least(F.lit(sizes[lvl - 1]), F.col("_n") - parent * F.lit(sizes[lvl - 1]))
        return F.ceil(held / F.lit(sizes[lvl])).cast("bigint")

    def level_nodes(lvl: int, size: int):
        def make(s: Column) -> Column:
            return F.struct(
                path(s, lvl, lvl).alias("node_id"),
                (path(s, lvl, lvl - 1) if lvl > 0 else F.lit(None).cast("string")).alias("parent_id"),
                F.lit(lvl).alias("level"),
                s.alias("seq"),
                *([F.array_join(F.slice(F.col("_t"), s * size + 1, F.lit(size)), " ").alias("text")] if texts else []),
                F.least(F.lit(size), F.col("_n") - s * size).alias("n_tokens"),
                (siblings(s, lvl) if lvl > 0 else F.lit(None).cast("bigint")).alias("siblings"),
            )

        return F.transform(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.lit(size)).cast("int") - 1), make)

    per_level = [level_nodes(lvl, size) for lvl, size in enumerate(sizes)]
    # All tiers of a document are built in its row and exploded once.
    out = (
        toks.select("doc_id", F.explode_outer(F.when(F.col("_n") > 0, F.concat(*per_level))).alias("n"))
        .filter(F.col("n").isNotNull())
        .select("n.node_id", "n.parent_id", "doc_id", "n.level", "n.seq", *(["n.text"] if texts else []), "n.n_tokens", "n.siblings")
    )
    return out.select(
        "node_id", "parent_id", "doc_id", "level", "seq", *(["text"] if texts else []), "n_tokens",
        (F.col("level") == len(sizes) - 1).alias("is_leaf"),
        "siblings",
    )


# Sentence end: after . ! ? followed by whitespace, or at a line break.
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"
SPAN_BLOCK = 128


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once (a one-element transform names it)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunk_spans(since: Column, left: Column, n_pieces: Column, size: int, overlap: int) -> Column:
    """(start, end) token positions of the packed chunks.

    ``since`` is each token's distance from the first token of its piece, ``left`` that to
    the first token behind it.
    """
    n = F.size(since)

    def end_of(start: Column) -> Column:
        """Where the piece begins that does not fit any more."""
        over = start + size
        return F.when(over >= n, n).otherwise(over - F.get(since, over))

    def next_start(end: Column) -> Column:
        """The first piece border within ``overlap`` tokens before ``end``, if the next piece fits behind it."""
        back = F.when(end <= overlap, F.lit(0)).otherwise(end - overlap - 1 + F.get(left, end - overlap - 1))
        carried = lambda b: F.when((b < end) & (end + F.get(left, end) - b <= size), b).otherwise(end)
        return F.when(end >= n, n).otherwise(_bind(back, carried))

    def step(state: Column, _: Column) -> Column:
        def follow(end: Column) -> Column:
            span = F.struct(state["at"].alias("start"), end.alias("end"))
            return F.struct(next_start(end).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.when(state["at"] >= n, state).otherwise(_bind(end_of(state["at"]), follow))

    # any two chunks in a row advance by more than size - overlap tokens, and each by a piece
    steps = F.least(n_pieces, F.floor(n / (size - overlap)).cast("int") * 2 + 2)
    spans = "array<struct<start:int,end:int>>"

    def block(at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(spans).alias("spans"))
        return F.aggregate(F.sequence(F.lit(1), F.least(steps, F.lit(SPAN_BLOCK))), begin, step)

    # in blocks, as each step of a fold copies what it has found
    blocks = F.aggregate(
        F.sequence(F.lit(1), F.ceil(steps / SPAN_BLOCK).cast("int")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("blocks")),
        lambda state, _: _bind(block(state["at"]), lambda x: F.struct(x["at"].alias("at"), F.concat(state["blocks"], F.array(x["spans"])).alias("blocks"))),
        lambda state: state["blocks"],
    )
    return F.flatten(blocks)


def chunk_sentences(
    docs: DataFrame,
    size: int = INGEST_CHUNK[0],
    overlap: int = INGEST_CHUNK[1],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """T2(b): greedy sentence packing.

    Sentences are packed while the chunk stays within ``size`` tokens; the
    next chunk starts with the trailing whole sentences of the previous one
    whose tokens sum to at most ``overlap``.  A sentence longer than ``size``
    is first cut into overlapping ``size``-token windows (T2a).

    A chunk is a run of whole pieces, so where it starts says where it ends and where
    the next one starts.  Two arrays, how far each token is from its piece's
    start and end, answer both by position; one step per chunk follows these
    pointers, and the texts are cut last.  No shuffle, no Python.
    Output: (node_id, doc_id, chunk_no, text, n_tokens).
    """
    sents = F.filter(
        F.transform(F.split(F.col(text_col), SENTENCE_SPLIT), lambda s: tokenize(s)),
        lambda t: F.size(t) > 0,
    )
    # a sentence longer than ``size`` is cut by the fixed-window rule
    stride = size - overlap
    pieces = F.flatten(
        F.transform(
            sents,
            lambda t: F.transform(
                F.sequence(F.lit(0), n_windows(F.size(t), size, overlap) - 1),
                lambda i: F.slice(t, i * stride + 1, F.lit(size)),
            ),
        )
    )
    packed = _bind(
        pieces,
        lambda ps: _bind(
            F.struct(
                F.flatten(ps).alias("words"),
                F.flatten(F.transform(ps, lambda p: F.sequence(F.lit(0), F.size(p) - 1))).alias("since"),
                F.flatten(F.transform(ps, lambda p: F.sequence(F.size(p), F.lit(1)))).alias("left"),
            ),
            lambda t: F.transform(
                _chunk_spans(t["since"], t["left"], F.size(ps), size, overlap),
                # word by word, as ``slice`` copies the whole array first
                lambda c: F.array_join(F.transform(F.sequence(c["start"], c["end"] - 1), lambda at: F.get(t["words"], at)), " "),
            ),
        ),
    )
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode_outer(F.when(F.size(pieces) > 0, packed)).alias("chunk_no", "text")
    ).filter(F.col("text").isNotNull())
    return out.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("node_id"),
        "doc_id", "chunk_no", "text", F.size(F.split("text", " ")).alias("n_tokens"),
    )


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent: by the ``is_leaf`` of the cut, else (tables
    without it) by a left anti join on parent_id."""
    if "is_leaf" in nodes.columns:
        return nodes.filter("is_leaf")
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull())
    return nodes.join(parents, "node_id", "left_anti")


def root_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes.filter(F.col("parent_id").isNull())
