"""A collection of records as a Spark data source (G04): `df.write.format("pagetide_collection")` and back.

A collection is a folder of Parquet parts and of commits that name them. Tasks write parts of their own; only the commit
at the end of a job makes them rows of the collection, so parts of failed or repeated tasks are never read. Appends may
bring new columns: the collection has the columns of all its commits, null where a part lacks one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "pagetide_collection"
_COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    files, at = fs.FileSystem.from_uri(path)
    return files, at.rstrip("/")


@dataclass
class Part(InputPartition):
    """One Parquet file of a collection and the bounds of its rows by column, as the commit has them."""

    name: str
    rows: int
    bounds: dict[str, list]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    parts: list[dict]


def _bounds(file: pq.FileMetaData) -> dict[str, list]:
    """Smallest and largest value of each integer or text column that has them in all row groups. Not of floats, whose
    bounds leave NaN out."""
    found: dict[str, list] = {}
    for k in range(file.num_columns):
        columns = [file.row_group(g).column(k) for g in range(file.num_row_groups)]
        stats = [c.statistics for c in columns]
        name = columns[0].path_in_schema if columns else ""
        if stats and "." not in name and all(s is not None and s.has_min_max for s in stats):
            low, high = min(s.min for s in stats), max(s.max for s in stats)
            if type(low) in (int, str):
                found[name] = [low, high]
    return found


def _excluded(part: Part, conditions: list[tuple[str, str, object]]) -> bool:
    """Whether the bounds of a part rule out all its rows."""
    for name, test, value in conditions:
        low, high = part.bounds.get(name, (None, None))
        if low is None or type(low) is not type(value):
            continue
        if (test in ("==", ">", ">=") and high < value) or (test in ("==", "<", "<=") and low > value):
            return True
        if (test == ">" and high == value) or (test == "<" and low == value):
            return True
    return False


def _commits(path: str) -> list[dict]:
    files, at = _opened(path)
    listed = files.get_file_info(fs.FileSelector(f"{at}/_commits", allow_not_found=True))
    names = sorted(i.path for i in listed if i.base_name.endswith(".json"))
    commits = []
    for name in names:
        with files.open_input_stream(name) as stream:
            commits.append(json.loads(stream.read()))
    # An overwriting commit ends what was before it.
    last = max((k for k, c in enumerate(commits) if c["overwrite"]), default=0)
    return commits[last:]


class _Reader(DataSourceReader):
    """One partition for each part that the filters may leave; columns that a part lacks are null."""

    def __init__(self, path: str, schema: StructType):
        self._path, self._schema = path, schema
        self._conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of a column with a constant choose parts; Spark tests the rows of those."""
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1:
                self._conditions.append((f.attribute[0], _COMPARED[type(f)], f.value))
            yield f

    def partitions(self) -> list[Part]:
        parts = [Part(**p) for c in _commits(self._path) for p in c["parts"]]
        # Spark wants a partition even of nothing.
        return [p for p in parts if not _excluded(p, self._conditions)] or [Part("", 0, {})]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        wanted = to_arrow_schema(self._schema)
        files, at = _opened(self._path)
        with files.open_input_file(f"{at}/{partition.name}") as stream:
            part = pq.ParquetFile(stream)
            have = [n for n in wanted.names if n in part.schema_arrow.names]
            # Only the columns that were asked for are read.
            for batch in part.iter_batches(columns=have):
                columns = [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted) if columns else batch


class _Writer(DataSourceArrowWriter):
    """Parts first, the commit that names them last."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self._path, self._schema, self._overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = _opened(self._path)
        name, rows, writer = f"parts/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(f"{at}/parts", recursive=True)
                stream = files.open_output_stream(f"{at}/{name}")
                writer = pq.ParquetWriter(stream, batch.schema, compression="zstd")
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Written([])
        writer.close()
        stream.close()
        with files.open_input_file(f"{at}/{name}") as written:
            return Written([{"name": name, "rows": rows, "bounds": _bounds(pq.read_metadata(written))}])

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _opened(self._path)
        files.create_dir(f"{at}/_commits", recursive=True)
        commit = {"overwrite": self._overwrite, "schema": self._schema.jsonValue(), "parts": [p for m in messages if m for p in m.parts]}
        # Commits are read in order of their names. Under its last name a commit is there as a whole.
        name = f"{at}/_commits/{time.time_ns():020}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.tmp") as stream:
            stream.write(json.dumps(commit).encode())
        files.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """The parts of the tasks that were through; those of failed ones stay unnamed, and so unread."""
        files, at = _opened(self._path)
        for part in (p for m in messages if m for p in m.parts):
            files.delete_file(f"{at}/{part['name']}")


class CollectionSource(DataSource):
    """The option `path` names the folder. A schema given to the reader reads only its columns."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        fields = {}
        for commit in _commits(self.options["path"]):
            for field in StructType.fromJson(commit["schema"]).fields:
                known = fields.setdefault(field.name, field)
                if known.dataType != field.dataType:
                    raise ValueError(f"column {field.name} has several types")
                known.nullable = True
        return StructType(list(fields.values()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> str:
    """Make the source known to a session; the name to give to `format`."""
    # Filters choose the parts that are read.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
    return NAME


def row_count(path: str) -> int:
    """Rows of a collection, by its commits alone; 0 without any."""
    return sum(p["rows"] for c in _commits(path) for p in c["parts"])
