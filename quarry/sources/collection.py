"""A collection of nodes as a data source with all-or-nothing writes.

::

    write_collection(df, path)
    read_collection(spark, path).where("category = 'rag'")

Tasks write Parquet files of one key value each (``key``, by default ``category``) below
``data/``; the commit of the job writes one manifest that names all files of all
tasks, and renames it into place last.  A reader takes the newest manifest once, when the
read is planned.  A job that fails or is aborted leaves the collection as it was, and the
files of retried tasks are named by no manifest.  Old files stay for readers that have
planned; one writer at a time.

Conditions on the key (``=``, ``IN``, ``IS [NOT] NULL``) choose files before any task starts;
this needs the session's ``spark.sql.python.filterPushdown.enabled``, and without it Spark
filters the rows.  A task holds one open file per key value, so the key has few values.  ``path`` is
any place pyarrow's file systems open and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FILTERS = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)


def located(path: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, base.rstrip("/")


def write_collection(df: DataFrame, path: str, mode: str = "overwrite", key: str = "category") -> None:
    """``df`` as the collection's rows, or further rows of it (``append``)."""
    df.sparkSession.dataSource.register(CollectionSource)
    df.write.format("collection").option("path", path).option("key", key).mode(mode).save()


def read_collection(spark: SparkSession, path: str, key: str = "category") -> DataFrame:
    """The newest version's rows."""
    spark.dataSource.register(CollectionSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("collection").option("path", path).option("key", key).option("pushdown", pushdown).load()


def newest(path: str) -> tuple[int, dict]:
    """(number, manifest) of the last published version; 0 and no files if there is none."""
    files, base = located(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
    numbers = [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]
    if not numbers:
        return 0, {"schema": None, "files": []}
    with files.open_input_stream(f"{base}/manifests/{max(numbers):012d}.json") as f:
        return max(numbers), json.loads(f.read())


@dataclass
class File(InputPartition):
    """A Parquet file of the rows with one key value."""

    name: str
    key: object

    def __init__(self, name: str, key: object):
        super().__init__(name)
        self.name, self.key = name, key


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, object]]


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> StructType:
        stored = newest(self.options["path"])[1]["schema"]
        if stored is None:
            raise ValueError(f"no collection at {self.options['path']}")
        return StructType.fromJson(json.loads(stored))

    def reader(self, schema: StructType) -> CollectionReader:
        made = PrunedReader if self.options.get("pushdown") == "true" else CollectionReader
        return made(self.options["path"], self.options.get("key", "category"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options["path"], self.options.get("key", "category"), schema, overwrite)


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType):
        self.path, self.key, self.schema = path, key, schema
        self.names = schema.names
        self.files = [File(n, k) for n, k in newest(path)[1]["files"]]

    def partitions(self) -> list[InputPartition]:
        return self.files or [File("", None)]  # a source has at least one

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            files, base = located(self.path)
            with files.open_input_file(f"{base}/{partition.name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                    yield batch.select(self.names)


class PrunedReader(CollectionReader):
    """Takes conditions on the key; Spark accepts this only with push-down switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, FILTERS) and f.attribute == (self.key,):
                self.files = [x for x in self.files if self.meets(f, x.key)]
            else:
                yield f

    @staticmethod
    def meets(f: Filter, key: object) -> bool:
        if isinstance(f, IsNull):
            return key is None
        if isinstance(f, EqualNullSafe):
            return key == f.value
        if key is None:  # a null equals nothing
            return False
        return key == f.value if isinstance(f, EqualTo) else key in f.value if isinstance(f, In) else True


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool):
        if key not in schema.names:
            raise ValueError(f"no column {key}")
        self.path, self.key, self.overwrite, self.schema = path, key, overwrite, schema.json()
        self.arrow = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = located(self.path)
        folder, open_files = f"data/{uuid.uuid4().hex}", {}
        files.create_dir(f"{base}/{folder}", recursive=True)
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch]).cast(self.arrow)
                column = table[self.key]
                for value in pc.unique(column):
                    key = value.as_py()
                    if key not in open_files:
                        name = f"{folder}/{len(open_files):05d}.parquet"
                        open_files[key] = (name, pq.ParquetWriter(f"{base}/{name}", self.arrow, filesystem=files))
                    open_files[key][1].write_table(table.filter(pc.is_null(column) if key is None else pc.equal(column, value)))
        finally:
            for _, f in open_files.values():
                f.close()
        return Written([(name, key) for key, (name, _) in open_files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files, base = located(self.path)
        number, before = newest(self.path)
        if not self.overwrite and before["schema"] not in (None, self.schema):
            raise ValueError("appended rows must have the collection's schema")
        kept = [] if self.overwrite else before["files"]
        added = [f for m in messages if m for f in m.files]
        files.create_dir(f"{base}/manifests", recursive=True)
        draft = f"{base}/manifests/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps({"schema": self.schema, "files": [*kept, *added]}).encode())
        files.move(draft, f"{base}/manifests/{number + 1:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, base = located(self.path)
        for name in [n for m in messages if m for n, _ in m.files]:
            files.delete_file(f"{base}/{name}")
