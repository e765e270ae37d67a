"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import work_path
from quarry.sources.tables import table

#: A word: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs no recomputation and several readers share one computation.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased.  ``bytes.lower`` and ``bytes.split``
    treat exactly A-Z and the six ASCII blanks, whatever the locale."""
    return text.encode("utf-8").lower().split() if text else []


def in_chunks(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


_ARROW_TYPES = {"long": "int64", "int": "int32", "double": "float64", "string": "string", "binary": "binary", "boolean": "bool_"}


def arrow_schema(ddl: str):
    """pyarrow schema of 'name type, name type'; types as in ``_ARROW_TYPES``, arrays and flat structs of them."""
    import pyarrow as pa

    def arrow_type(t: str):
        if t.startswith("array<"):
            return pa.list_(arrow_type(t[6:-1]))
        if t.startswith("struct<"):
            return pa.struct([(name, arrow_type(kind)) for name, kind in (f.split(":") for f in t[7:-1].split(","))])
        return getattr(pa, _ARROW_TYPES[t])()

    return pa.schema([(name, arrow_type(t)) for name, t in (field.split() for field in ddl.split(", "))])


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[list[tuple]]], ddl: str) -> DataFrame:
    """``mapInArrow`` with plain Python values: ``fn`` gets the partition's batches as
    {column: list} and yields lists of row tuples of the schema ``ddl``."""

    def run(batches):
        import pyarrow as pa

        schema = arrow_schema(ddl)
        for rows in fn(b.to_pydict() for b in batches):
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def add_columns(df: DataFrame, source: str, start: Callable[[], Callable[[list], list[tuple]]], ddl: str) -> DataFrame:
    """``df`` with the columns of ``ddl`` added (or replaced), computed from column ``source``.

    ``start()`` runs once per task and gives a function from a batch's values to one
    tuple per row.  The other columns pass through as Arrow data.
    """
    names = [field.split()[0] for field in ddl.split(", ")]
    df = df.select(*[c for c in df.columns if c not in names or c == source])
    at, kept = df.columns.index(source), [i for i, c in enumerate(df.columns) if c not in names]
    schema = StructType([df.schema.fields[i] for i in kept] + StructType.fromDDL(ddl).fields)

    def run(batches):
        import pyarrow as pa

        answer, added = start(), arrow_schema(ddl)
        for b in batches:
            rows = answer(b.column(at).to_pylist())
            columns = zip(*rows) if rows else [()] * len(added)
            new = [pa.array(c, f.type) for c, f in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new], names=schema.names)

    return df.mapInArrow(run, schema)


def text_key(data: bytes) -> int:
    """With the id, names a text: rows of one id and different texts stay apart."""
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed): compressed texts."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = [(t or "").encode() for t in b["text"]]
            yield [(i, text_key(d), packer.compress(d)) for i, d in zip(b["doc_id"], data)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, text_key long, packed binary")


def same_text(other: str) -> Column:
    """Join condition between (doc_id, text_key) and ({other}_id, {other}_key)."""
    return F.col("doc_id").eqNullSafe(F.col(f"{other}_id")) & (F.col("text_key") == F.col(f"{other}_key"))
