"""Sources and sinks: files as (path, modificationTime, length, content) rows, the Python data source ``pdf``, and a file sink.

``read_pdfs`` keeps Spark's own binary file source (any file system Spark knows, also as a stream). The data source
``pdf`` opens files in its readers, a partition for each group of files, and gives a table of them directly:

    spark.dataSource.register(PdfDataSource)
    spark.read.format("pdf").option("table", "pages").load("folder")
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quire.operators.tables import BYTES, ROWS, SCHEMAS, rows_of


def read_pdfs(spark: SparkSession, path: str, *, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def stream_pdfs(spark: SparkSession, path: str, *, pattern: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _filesystem(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "path string, " + SCHEMAS[self.options.get("table", "info")] + ", error string"

    def reader(self, schema) -> "PdfReader":
        return PdfReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> "PdfWriter":
        return PdfWriter(self.options, overwrite)


class PdfReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.names = options, [f.name for f in schema.fields]
        self.table = options.get("table", "info")

    def partitions(self) -> list[Files]:
        import pyarrow.fs as fs

        system, path = _filesystem(self.options["path"])
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")]
        most, groups, size = int(self.options.get("partitionbytes", 64 << 20)), [[]], 0
        for f in sorted(files, key=lambda f: f.path):
            if groups[-1] and size + f.size > most:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        from quire.kernels.document import Document, PdfError

        system, _ = _filesystem(self.options["path"])
        for path in partition.paths:
            try:
                with system.open_input_file(path) as f:
                    doc = Document(f.read(), self.options.get("password"))
                found = rows_of(self.table, doc)
                error = None
            except (PdfError, ValueError, RecursionError) as e:
                if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                    raise
                found, error = [{}], f"{type(e).__name__}: {e}"
            for r in found:
                yield tuple({"path": path, "error": error, **r}.get(n) for n in self.names)


class Written(WriterCommitMessage):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


class PdfWriter(DataSourceWriter):
    """A file for each row: ``name`` (a path below the folder) and ``content``; files get their names when the whole job has succeeded.

    Two rows of one name, a null name or content, a name that leaves the folder, and without ``overwrite`` a file that is
    there already are errors: nothing gets its name then.
    """

    def __init__(self, options, overwrite: bool = False):
        self.options, self.overwrite = options, overwrite

    def write(self, rows) -> Written:
        system, folder = _filesystem(self.options["path"])
        done = []
        for r in rows:
            if r["name"] is None or r["content"] is None:
                raise ValueError(f"no name or no content: {r['name']}")
            name = posixpath.normpath(r["name"].lstrip("/"))
            if name.startswith("..") or name == ".":
                raise ValueError(f"not a name below the folder: {r['name']}")
            at = posixpath.join(folder, posixpath.dirname(name))
            system.create_dir(at, recursive=True)
            part = f"{at}/.{posixpath.basename(name)}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            done.append((part, f"{folder}/{name}"))
        return Written(done)

    def commit(self, messages) -> None:
        import pyarrow.fs as fs

        system, _ = _filesystem(self.options["path"])
        pairs = [p for m in messages if m for p in m.pairs]
        finals = [final for _, final in pairs]
        twice = sorted(name for name, n in Counter(finals).items() if n > 1)
        there = [] if self.overwrite else [i.path for i in system.get_file_info(finals) if i.type != fs.FileType.NotFound]
        if twice or there:
            raise FileExistsError(f"{len(twice)} names are given twice, {len(there)} files are there already: {(twice + there)[:3]}")
        for part, final in pairs:
            system.move(part, final)

    def abort(self, messages) -> None:
        system, _ = _filesystem(self.options["path"])
        for m in messages:
            for part, _ in m.pairs if m else []:
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(part)


def from_rows(df: DataFrame, build, keys: list[str]) -> DataFrame:
    """Documents made of rows: ``build(row)`` gives the bytes of one. For tests and for the driver's tables."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("content", T.BinaryType())])

    def run(batches):
        for batch in batches:
            step = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                began, made, size = 0, [], 0
                for i in range(part.num_rows):  # documents that are made may be larger than their rows
                    made.append(build({c: part.column(c)[i].as_py() for c in part.schema.names}))
                    size += len(made[-1])
                    if size >= BYTES or i + 1 == part.num_rows:
                        yield pa.RecordBatch.from_arrays([*(part.column(k).slice(began, len(made)) for k in keys), pa.array(made, pa.binary())], names=schema.names)
                        began, made, size = i + 1, [], 0

    return df.mapInArrow(run, schema)


def with_name(df: DataFrame, name) -> DataFrame:
    return df.select(F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), "content")
