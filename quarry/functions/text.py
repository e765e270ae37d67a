"""Text column expressions (all JVM-side, no Python UDFs).

Each function takes and returns a ``Column`` so it composes inside
``select``/``withColumn`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference behaviour.
# Word token = maximal run of Unicode letters, Unicode digits and underscore,
# which is what Python's ``\b\w+\b`` matches on str input.  Plain ``\w`` in the
# JVM (and in RE2) is ASCII only, so the class is spelled out.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
# Python ``str.strip()`` removes every whitespace character at both ends;
# Spark ``trim`` only removes spaces.
LEADING_WS = r"^\s+"
TRAILING_WS = r"\s+$"
# Lineage value stamped on every enriched node.
SOURCE_TAG = "local_documents"
# Separator between fields that enter a content hash.
HASH_SEP = "\u0001"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """Lower-case word tokens, duplicates and order kept."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def py_strip(text) -> Column:
    """Whitespace strip with Python ``str.strip()`` semantics."""
    return F.regexp_replace(F.regexp_replace(_c(text), LEADING_WS, ""), TRAILING_WS, "")


def snippet(text, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(text), 1, n)


def stable_doc_id(file_name, doc_id) -> Column:
    """Document id = file name when present, else the given id."""
    return F.coalesce(_c(file_name), _c(doc_id).cast("string"))


def document_name(file_name) -> Column:
    """``lower(strip(file_name))`` only for a non-empty name, else null."""
    f = _c(file_name)
    return F.when(F.length(f) > 0, F.lower(py_strip(f)))


def category(file_name) -> Column:
    """Category by substring of the lower-cased file name, first match wins."""
    f = F.lower(F.coalesce(_c(file_name), F.lit("")))
    return F.when(f.contains("rag"), F.lit("rag")).when(f.contains("python"), F.lit("python")).otherwise(F.lit("general"))


def content_hash(*cols) -> Column:
    """SHA-256 over text + metadata fields, the identity used by fusion (F4) and upserts."""
    return F.sha2(F.concat_ws(HASH_SEP, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]), 256)


def split_lines_clean(text) -> Column:
    """Split into lines, Python-strip each, drop empties, keep order."""
    parts = F.split(_c(text), "\n")
    stripped = F.transform(parts, lambda x: py_strip(x))
    return F.filter(stripped, lambda x: x != F.lit(""))


def identifier_like(text) -> Column:
    """True when the text holds an identifier: letters-dash-digits (``ERR-401``) or a digit run (R4 rule)."""
    return _c(text).rlike(r"[A-Za-z]+-[0-9]+|[0-9]+")
