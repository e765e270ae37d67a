"""Language-model scoring: marginal likelihood over all subword segmentations.

The vocabulary is an existing public one (never trained here); a piece's score
is its smoothed log frequency in the training texts.  A word's probability sums
over *all* ways to cut it into pieces, by a forward recursion in log space over
its lattice of characters; a text's is the product over its words and one end
token.  Pieces do not cross blanks, so equal words have equal probability and
the lattice is run once per distinct word, not per occurrence:

1. ``vocabulary``: (word, count in training texts) of all texts, pre-counted in
   each task and summed; stored.
2. ``piece_scores``: the training words cut by the existing tokenizer give
   piece counts (one row per piece at most, so bounded by the vocabulary file).
3. ``word_scores``: per distinct word the base log probability and the lattice's.
4. ``score``: each text adds up the words' values.  The ``head`` most frequent
   words (a fixed number, so a bounded broadcast) are added up where the text is
   read; each other word travels as one row per text and word and meets the word
   table in a join, where no key is frequent by construction.

Defined cases: null or empty text is the end token alone; repeated rows each
give a row; a null id hashes like '' for the split; without training texts all
counts are 0 (every word gets the smoothing mass); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, documents, map_rows, stored, words_of

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
HEAD_WORDS = 100_000
#: Distinct words a task counts before it passes its partial counts on.
FLUSH = 400_000
SMOOTHING = 0.5
LN10 = math.log(10.0)


def held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def vocabulary(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(word, c): every word of the texts with its count in the training texts."""

    def count(batches: Iterator[dict]) -> Iterator[list]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                if held_out(doc_id, folds, fold):
                    for w in set(words):
                        counts[w] += 0
                else:
                    counts.update(words)
                if len(counts) > FLUSH:
                    yield [(w.decode(), c) for w, c in counts.items()]
                    counts.clear()
        yield [(w.decode(), c) for w, c in counts.items()]

    return map_rows(docs.select("doc_id", "text"), count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_scores(words: DataFrame, model: bytes, n_train: int) -> tuple[dict[str, float], float]:
    """Natural-log probability of every vocabulary piece, and of the end of a text."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = pieces.get_piece_size()

    def count(batches: Iterator[dict]) -> Iterator[list]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        counts: Counter = Counter()
        for batch in batches:
            for ids, c in zip(sp.encode(batch["word"], num_threads=1), batch["c"]):
                for i in ids:
                    counts[i] += c
        yield list(counts.items())

    rows = map_rows(words.where("c > 0"), count, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = {r.piece: r.n for r in rows}
    total = sum(counts.values()) + n_train + SMOOTHING * (size + 1)
    scores = {pieces.id_to_piece(i): math.log((counts.get(i, 0) + SMOOTHING) / total) for i in range(size) if not (pieces.is_control(i) or pieces.is_unknown(i))}
    return scores, math.log((n_train + SMOOTHING) / total)


def lattice(scores: dict[str, float]) -> Callable[[str], float]:
    """word -> natural log of the summed probability of all its segmentations.

    A character that is no piece itself is spelled by its UTF-8 byte pieces, so
    every word has one.
    """
    longest = max(map(len, scores), default=1)
    byte = [scores.get(f"<0x{b:02X}>", -50.0) for b in range(256)]
    plain = {p: s for p, s in scores.items() if not (len(p) == 6 and p.startswith("<0x"))}
    prefixes = {p[:n] for p in plain for n in range(1, len(p) + 1)}
    exp, log = math.exp, math.log

    def spelled(ch: str) -> float:
        return sum(byte[b] for b in ch.encode("utf-8"))

    def score(word: str) -> float:
        word = "▁" + word
        n = len(word)
        ahead: list[list[float]] = [[] for _ in range(n + 1)]  # log probabilities of the paths that end at each position
        reached = 0.0
        for i in range(n):
            if i:
                paths = ahead[i]
                top = max(paths)
                reached = top + log(sum([exp(p - top) for p in paths])) if len(paths) > 1 else top
                ahead[i] = []
            if word[i] not in plain:
                ahead[i + 1].append(reached + spelled(word[i]))
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = word[i:j]
                if piece not in prefixes:
                    break
                s = plain.get(piece)
                if s is not None:
                    ahead[j].append(reached + s)
        top = max(ahead[n])
        return top + log(sum(exp(p - top) for p in ahead[n]))

    return score


def word_scores(words: DataFrame, scores: dict[str, float], n: int, v: int) -> DataFrame:
    """(word, c, base, model): log10 probabilities of each distinct word."""
    sent = words.sparkSession.sparkContext.broadcast(scores)  # bounded by the vocabulary file

    def run(batches: Iterator[dict]) -> Iterator[list]:
        score = lattice(sent.value)
        mass = n + SMOOTHING * (v + 1)
        for batch in batches:
            yield [(w, c, math.log10((c + SMOOTHING) / mass), score(w) / LN10) for w, c in zip(batch["word"], batch["c"])]

    return map_rows(words, run, "word string, c long, base double, model double")


def most_frequent(words: DataFrame, head: int) -> DataFrame:
    """The words at or above the lowest count that at most ``head`` words reach; counts are told
    apart to a sixteenth of a power of two, so only a short histogram comes to the driver."""
    level = F.floor(F.log2(F.col("c")) * 16)
    least, n = None, 0
    for r in words.where("c > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        n += r.n
        if n > head:
            break
        least = r.level
    return words.where(F.col("c") > 0).where(level >= least) if least is not None else words.limit(0)


def score(docs: DataFrame, tokenizer: str = TOKENIZER, folds: int = 5, fold: int = 1, head: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Texts whose crc32(doc_id) mod ``folds`` is ``fold`` are held out of all counts.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        model = f.read()
    counted = stored(vocabulary(docs, folds, fold), "lm-words")
    n_train = docs.where(crc_mod("doc_id", folds) != fold).count()
    sums = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (sums.n or 0) + n_train, sums.v + (n_train > 0)
    pieces, end = piece_scores(counted, model, n_train)
    words = stored(word_scores(counted, pieces, n, v), "lm-word-scores")
    base_end = math.log10((n_train + SMOOTHING) / (n + SMOOTHING * (v + 1)))
    frequent = most_frequent(words, head).collect()
    table = spark.sparkContext.broadcast({r.word.encode(): (r.c > 0, r.base, r.model) for r in frequent})  # ``head`` rows

    def add_up(batches: Iterator[dict]) -> Iterator[list]:
        known = table.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                key = xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
                words = words_of(text)
                n_known, base, total = int(n_train > 0), base_end, end / LN10
                for w, k in Counter(words).items():
                    hit = known.get(w)
                    if hit is None:
                        out.append((doc_id, key, w.decode(), k, None, None, None, None))
                    else:
                        n_known += k * hit[0]
                        base += k * hit[1]
                        total += k * hit[2]
                # a blank cannot be part of a word, so the text's own row meets no word
                out.append((doc_id, key, f" {key}", None, len(words) + 1, n_known, base, total))
                if len(out) > 200_000:
                    yield out
                    out = []
            yield out

    rows = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), add_up, "doc_id long, text_key long, word string, k long, n_tokens long, n_known long, base_score double, score double")
    met = rows.join(words, "word", "left")
    k = F.col("k")
    per_text = met.groupBy("doc_id", "text_key").agg(
        F.count("n_tokens").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce(F.when(F.col("c") > 0, k), "n_known", F.lit(0))).alias("n_known"),
        F.sum(F.coalesce(k * F.col("base"), "base_score")).alias("base_score"),
        F.sum(F.coalesce(k * F.col("model"), "score")).alias("score"),
    )
    each = lambda c: F.col(c) / F.col("copies")  # noqa: E731  equal rows were added up together
    return per_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        (crc_mod("doc_id", folds) == fold).alias("held_out"),
        "n_tokens",
        each("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        each("base_score").alias("base_score"),
        each("score").alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir, "text"))


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLE: dict[str, str] = {}
