r"""Secret scans: pattern kinds plus sliding-window entropy, in DataFrame functions only.

Every kind gives spans ``(start, end)`` in code points, end exclusive, leftmost
and non-overlapping:

- ``assign``, ``access``, ``hex``: fixed patterns; too short matches are dropped
  *after* matching, so they still consume their text.
- ``entropy_hex``, ``entropy_base64``: the method.  Candidate strings are maximal
  runs of one character class.  A window of ``WINDOW`` characters slides over a
  candidate; counts per character and the sum of c*log2(c) are updated for the
  one character that leaves and the one that enters, and the Shannon entropy is
  log2(w) - sum / w.  Overlapping windows at or over the class's threshold merge
  into one span.  Segments (between separators) with a placeholder or an ordered
  alphabet and a leading integrity digest of its full length are cut out of a
  candidate; the parts that remain are scanned, if they are not on the allow-list
  (word-like strings, numbers, UUIDs),
  and what a pattern span covers is not reported twice: the rest of an entropy
  span is kept where it still holds a high window (likewise base64 beside hex).

Positions need no search: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, and their lengths sum up to the starts.
Sums run in blocks so that a text with very many matches stays near linear.

Defined cases: null text counts as empty; no match gives empty spans and the
digest of ''; repeated rows each give a row; other columns pass through (``scan``
replaces columns named as its own three); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents

# Pattern kinds in report order, (pattern, group to measure, least length of it).
PATTERNS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # a maximal run, so the same spans as [0-9a-f]+ with short ones dropped
}
#: Character classes: candidate pattern, alphabet, least entropy in bits of a window.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 3.0),
    "entropy_base64": (r"[0-9A-Za-z+/_=-]{20,}", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.9),
}
WINDOW = 20
#: An integrity digest by prefix: all of its hexadecimal or base64 digits, not followed by more.
DIGEST = "(?:" + "|".join(f"{name}[-=_](?:[0-9A-Fa-f]{{{bits // 4}}}|[0-9A-Za-z+/_-]{{{-(-bits // 6)}}}={{0,{-(bits // 8) % 3}}})" for name, bits in (("md5", 128), ("sha1", 160), ("sha256", 256), ("sha384", 384), ("sha512", 512))) + ")(?![0-9A-Za-z+])"
#: A segment, a run without separators, that holds one of these words.
PLACEHOLDER = r"(?<![0-9A-Za-z+])[0-9A-Za-z+]*(?i:example|placeholder|changeme|dummy|xxxxxx|0123456789|abcdefgh)[0-9A-Za-z+]*"
#: Pairs of letters that are usual in words of the four languages and in identifiers.
PAIRS = (
    "a[bcdgilmnprstuvy]|b[aeilorsuy]|c[aehiklorstu]|d[aeiorsuy]|e[acdefgilmnprstuvwxy]|f[aefilortu]|g[aehilnorstu]|h[aeiortuy]|i[acdefglmnoprstvz]"
    "|j[aeou]|k[aeinsy]|l[adefiklostuvy]|m[abeimopsuy]|n[acdefgiknostuvy]|o[abcdfgiklmnoprstuvwxy]|p[aehiloprstuy]|qu|r[acdeghiklmnoprstuvy]"
    "|s[acehikmnopqstuwy]|t[acehilorstuwyz]|u[abcdefgilmnprstv]|v[aeioy]|w[aehinors]|x[aceipt]|y[aelmnopst]|z[aeiotuyz]"
)
#: Two other pairs in a row; a string without digits is word-like if it has this in one place at most.
ODD = f"(?:(?!{PAIRS})[a-z](?=[a-z])){{2}}"
#: Parts that match one of these are no secrets.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    rf"(?i)^(?!.*?{ODD}.*?{ODD})[a-z+/_=-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    rf"^{DIGEST}$",
    rf"^{PLACEHOLDER}$",
)
KINDS = [*PATTERNS, *CLASSES]
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint>>"
BLOCK = 256


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """``add`` over the elements before each element, [zero, v1, v1 + v2, ...] without the total; in blocks."""

    def before(values: Column, start: Column) -> Column:
        """Of a short array."""
        grown = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
        return F.slice(grown, 1, F.size(values))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda v: F.aggregate(v, zero, add))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(
        F.flatten(F.zip_with(blocks, before(totals, zero), lambda v, start: before(v, start)))
    )


def running_sums(lengths: Column) -> Column:
    return running(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x)


def pattern_of(kind: str) -> str:
    return (PATTERNS.get(kind) or CLASSES[kind])[0]


def matches_of(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern_of(kind)), F.lit(0))


def starts(matches: Column, pieces: Column) -> Column:
    """Start of each match: the pieces and matches before it, and the piece just before it."""
    own = F.slice(pieces, 1, F.size(matches))
    steps = F.zip_with(own, matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    return F.zip_with(running_sums(steps), own, lambda s, p: s + F.length(p))


def log_term(c: Column) -> Column:
    """c * log2(c), looked up among the few possible counts."""
    return F.element_at(F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(WINDOW + 1)]), c + 1)


def changed(counts: Column, code: Column, by: int, size: int) -> Column:
    """``counts`` with ``by`` added at the 1-based position ``code``."""
    return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(F.element_at(counts, code) + by), F.slice(counts, code + 1, F.lit(size)))


def high_windows(candidate: Column, alphabet: str, least: float) -> Column:
    """Merged (start, end) inside ``candidate`` of the windows with an entropy of at least ``least``.

    A fold over the characters; its state is the counts per character of the
    window, their sum of c*log2(c), and the runs found so far.
    """
    folded = F.lower(candidate) if alphabet == alphabet.lower() else candidate
    codes = F.transform(F.regexp_extract_all(folded, F.lit("."), F.lit(0)), lambda ch: F.instr(F.lit(alphabet), ch).cast("int"))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))

    def leave(state: Column, code: Column) -> Column:
        c = F.element_at(state["counts"], code)
        return F.struct(changed(state["counts"], code, -1, len(alphabet)).alias("counts"), (state["total"] - log_term(c) + log_term(c - 1)).alias("total"), state["runs"].alias("runs"))

    def enter(state: Column, code: Column, i: Column) -> Column:
        c = F.element_at(state["counts"], code)
        total = state["total"] - log_term(c) + log_term(c + 1)
        window = F.struct((i - WINDOW + 1).alias("start"), (i + 1).alias("end"))
        runs, last = state["runs"], F.get(state["runs"], F.size(state["runs"]) - 1)
        joins = F.coalesce(last["end"] >= window["start"], F.lit(False))
        grown = F.when(joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), window["end"].alias("end"))))).otherwise(F.concat(runs, F.array(window)))
        high = (i >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= least - 1e-9)
        return F.struct(changed(state["counts"], code, 1, len(alphabet)).alias("counts"), total.alias("total"), F.when(high, grown).otherwise(runs).alias("runs"))

    def step(state: Column, i: Column, bound: Column) -> Column:
        left = F.when(i >= WINDOW, leave(state, F.get(bound, i - WINDOW))).otherwise(state)
        return F.element_at(F.transform(F.array(left), lambda s: enter(s, F.get(bound, i), i)), 1)  # a one-element transform binds a value to a name

    def fold(bound: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(bound) - 1), start, lambda state, i: step(state, i, bound), lambda state: state["runs"])

    return F.element_at(F.transform(F.array(codes), fold), 1)


def allowed(candidate: Column) -> Column:
    return reduce(lambda a, b: a | b, [candidate.rlike(p) for p in ALLOWED])


def secret_runs(candidate: Column, kind: str) -> Column:
    """``high_windows`` of the parts of ``candidate`` that the allow-list leaves."""
    _, alphabet, least = CLASSES[kind]
    cut = rf"^{DIGEST}|{PLACEHOLDER}"
    none = F.array().cast("array<struct<start:int,end:int>>")
    runs = lambda part: F.when((F.length(part) < WINDOW) | allowed(part), none).otherwise(high_windows(part, alphabet, least))

    def of_parts(taken: Column, parts: Column) -> Column:
        after = F.zip_with(starts(taken, parts), taken, lambda s, m: (s + F.length(m)).cast("int"))
        moved = lambda part, at: F.transform(runs(part), lambda r: F.struct((at + r["start"]).alias("start"), (at + r["end"]).alias("end")))
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(0)), after), moved))

    whole = F.regexp_extract_all(candidate, F.lit(cut), F.lit(0))
    return F.when(candidate.rlike(cut), of_parts(whole, F.split(candidate, cut, -1))).otherwise(runs(candidate))


def pattern_spans(kind: str, matches: Column, pieces: Column) -> Column:
    _, group, least = PATTERNS[kind]
    measured = lambda m: F.length(F.regexp_extract(m, pattern_of(kind), group))
    at = F.zip_with(starts(matches, pieces), matches, lambda s, m: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (s + F.length(m)).alias("end"), (measured(m) >= least).alias("kept")))
    return F.transform(F.filter(at, lambda x: x["kept"]), lambda x: F.struct(x["start"], x["kind_no"], x["end"])).cast(SPAN)


def entropy_spans(kind: str, matches: Column, pieces: Column) -> Column:
    at = F.zip_with(starts(matches, pieces), matches, lambda s, m: F.struct(s.alias("start"), m.alias("match")))
    runs = F.transform(at, lambda x: F.transform(secret_runs(x["match"], kind), lambda r: F.struct((x["start"] + r["start"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (x["start"] + r["end"]).alias("end"))))
    return F.flatten(runs).cast(SPAN)


def uncovered(spans: Column, covers: Column, kind: str, body: Column) -> Column:
    """``spans`` of one entropy kind without what ``covers`` (by start) holds; of a cut span the parts with a high window."""
    _, alphabet, least = CLASSES[kind]
    state = lambda at, parts: F.struct(at.alias("at"), parts.alias("parts"))

    def piece(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"))

    def rest(x: Column, over: Column) -> Column:
        step = lambda s, c: state(F.greatest(s["at"], c["end"]), F.concat(s["parts"], F.array(piece(s["at"], c["start"]))))
        done = lambda s: F.concat(s["parts"], F.array(piece(s["at"], x["end"])))
        parts = F.aggregate(over, state(x["start"], F.array().cast(SPAN)), step, done)
        high = lambda p: F.size(high_windows(F.substr(body, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")), alphabet, least)) > 0
        return F.filter(F.filter(parts, lambda p: p["end"] - p["start"] >= WINDOW), high)

    def cut(x: Column) -> Column:
        over = F.filter(covers, lambda c: (c["start"] < x["end"]) & (x["start"] < c["end"]))
        return F.element_at(F.transform(F.array(over), lambda o: F.when(F.size(o) == 0, F.array(x)).otherwise(rest(x, o))), 1)

    return F.flatten(F.transform(spans, cut)).cast(SPAN)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` (pattern spans), ``found`` (and entropy spans that touch none of
    them) and ``whole`` (and what they leave of the others), arrays of
    (start, kind_no, end) by start, then kind; ``kind_no`` indexes ``KINDS``."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    out = docs.withColumns({f"_m_{k}": matches_of(body, k) for k in KINDS})
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(body, pattern_of(k), -1)) for k in KINDS})
    for kind in KINDS:
        of_kind = (pattern_spans if kind in PATTERNS else entropy_spans)(kind, F.col(f"_m_{kind}"), F.col(f"_p_{kind}"))
        out = out.withColumn(f"_s_{kind}", F.when(F.size(f"_m_{kind}") > 0, of_kind).otherwise(none))
    base = F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in PATTERNS]))
    out = out.withColumn("base", base)
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter(F.concat(*[F.col(f"_s_{k}") for k in CLASSES]), clear)
    # a hexadecimal run is a base64 run as well: report it once
    hexes = F.filter(more, lambda x: x["kind_no"] == KINDS.index("entropy_hex"))
    more = F.filter(more, lambda x: (x["kind_no"] == KINDS.index("entropy_hex")) | ~F.exists(hexes, lambda h: (h["start"] < x["end"]) & (x["start"] < h["end"])))
    any_entropy = sum(F.size(f"_s_{k}") for k in CLASSES) > 0
    out = out.withColumn("found", F.when(any_entropy, F.array_sort(F.concat("base", more))).otherwise(F.col("base")))
    out = out.withColumn("_hexes", F.when(F.size("_s_entropy_hex") > 0, uncovered(F.col("_s_entropy_hex"), F.col("base"), "entropy_hex", body)).otherwise(none))
    covers = F.when(F.size("_hexes") > 0, F.array_sort(F.concat("base", "_hexes"))).otherwise(F.col("base"))
    rest = F.when(F.size("_s_entropy_base64") > 0, uncovered(F.col("_s_entropy_base64"), covers, "entropy_base64", body)).otherwise(none)
    out = out.withColumn("whole", F.when(any_entropy, F.array_sort(F.concat("base", "_hexes", rest))).otherwise(F.col("base")))
    return out.drop("_hexes", *[f"_{c}_{k}" for c in "mps" for k in KINDS])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the spans that ``scan`` reports as ``whole`` by ``mark``, spans that overlap
    or touch by one.  Texts without a span, nulls too, and all other columns stay as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(rows).select("row", "text", "whole")
    upto = running(F.transform("whole", lambda x: x["end"]), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))  # where the spans before end
    between = lambda x, end: F.substr("text", (F.greatest(end, F.lit(0)) + 1).cast("int"), (x["start"] - F.greatest(end, F.lit(0))).cast("int"))
    pieces = F.zip_with("whole", upto, lambda x, end: F.when(x["start"] > end, F.concat(between(x, end), F.lit(mark))).otherwise(F.lit("")))
    rest = F.substr("text", (F.array_max(F.transform("whole", lambda x: x["end"])) + 1).cast("int"))
    hidden = F.when(F.size("whole") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    return found.select(*[(hidden if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind_no"] == KINDS.index(kind))).cast("long")
    return scan(documents(spark, sf_dir, "text")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("whole")).alias("spans"),
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE: dict[str, str] = {}
