"""Reading files and the registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import registry as Y
from quillmill.sinks.files import recover


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """pdf, size of the files below a folder, sorted by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("pdf"), F.col("length").alias("size")).orderBy("pdf")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry table, or an empty one where there is none or a file of it can't be read. What a stopped writer left is put right first."""
    recover(spark, path)
    try:
        # The footers of all files are read here: with a schema given, a corrupt one would fail a later job instead.
        spark.read.option("mergeSchema", "true").parquet(path)
    except (AnalysisException, SparkRuntimeException, PySparkException, Py4JJavaError):
        return spark.createDataFrame([], Y.SCHEMA)
    return spark.read.schema(Y.SCHEMA).parquet(path)


class Content:
    """A file's bytes, read from its file system when they are asked for: len(), read, seek, pieces, bytes() and comparison with bytes."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            system, path = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            system, path = fs.FileSystem.from_uri(quote(path, safe="/:@"))
        self._file = system.open_input_file(path)
        self.read, self.seek, self.tell, self.close = self._file.read, self._file.seek, self._file.tell, self._file.close

    def __len__(self) -> int:
        return self._file.size()

    def __bytes__(self) -> bytes:
        self.seek(0)
        return self.read()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, bytes) and len(self) == len(other) and bytes(self) == other

    __hash__ = None

    def pieces(self, size: int = 1 << 20) -> Iterator[bytes]:
        """The whole file in pieces of so many bytes."""
        self.seek(0)
        while piece := self.read(size):
            yield piece


def _scan(spark: SparkSession, folder: str, pattern: str, reader: Callable[[str, Content], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """A reader's rows of each file below folder, or one with an error.

    Spark lists the files and deals them out by size; a worker opens each where it reads it, so neither the JVM nor a batch
    holds a file, and files over the 2 GB of a binary value are read too.
    """
    none = dict.fromkeys(schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    content = Content(path)
                    try:
                        rows = [r | {"pdf": path, "error": None} for r in reader(path, content)]
                    finally:
                        content.close()
                except Exception as e:  # noqa: BLE001 - one bad file doesn't end the scan
                    rows = [none | {"pdf": path, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path").mapInArrow(read, ddl)


def scan_documents(spark: SparkSession, folder: str, pattern: str, reader: Callable[[str, Content], list[dict]], pages: str = "page_num int, text string") -> DataFrame:
    """pdf, pages' columns, error: every file's pages by a reader of (path, content).

    A file that can't be read is a row with an error. A file is one reader's, so a task reads its largest file whole, as the reader asks for it.
    """
    ddl = f"pdf string, {pages}, error string"
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
    return _scan(spark, folder, pattern, reader, schema, ddl)


def scan_tables(spark: SparkSession, folder: str, pattern: str, reader: Callable[[str, Content], list[dict]]) -> DataFrame:
    """pdf, page_num, rows, error: the useful tables of every file, by a reader that gives a page's number and rows of cells for each."""
    from quillmill.operators.render import useful_table

    kind = pa.list_(pa.list_(pa.string()))
    schema = pa.schema([("pdf", pa.string()), ("page_num", pa.int32()), ("rows", kind), ("error", pa.string())])
    found = _scan(spark, folder, pattern, reader, schema, "pdf string, page_num int, rows array<array<string>>, error string")
    return found.where(F.col("error").isNotNull() | useful_table(F.col("rows")))


def first_page(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """pdf, text, tables (arrays of rows, by page): the text of each file's first page with the tables of all its pages."""
    own = pages.where("page_num = 0").select("pdf", "text")
    listed = tables.where("error IS NULL").groupBy("pdf").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "rows"))), lambda t: t["rows"]).alias("tables"))
    return own.join(listed, "pdf", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<array<array<string>>>")))
