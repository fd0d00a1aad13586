"""Python data sources: trees of notes, transcripts, commit exports and causal
edges, read by `spark.read.format(...)` and `spark.readStream.format(...)`."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .notes import HOUSEKEEPING

#: Bytes of files that one partition reads.
PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    names: list[str]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + posixpath.abspath(path.removeprefix("file:")))


def _listed(path: str, ending: str) -> list[tuple[str, int, int]]:
    """(name under the path, size, time of change in ns), by name."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    rows = [(f.path[len(root) :].lstrip("/"), f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(ending)]
    return sorted(r for r in rows if not set(r[0].split("/")) & set(HOUSEKEEPING))


def _dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    out, held = [], most
    for name, size, _ in files:
        if held + size > most or not out:
            out.append(Files([]))
            held = 0
        out[-1].names.append(name)
        held += size
    return out or [Files([])]


class _Reader(DataSourceReader):
    def __init__(self, source: _Tree):
        self.source, self.kept = source, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and beginnings of the key that files are named
        by choose files before any is opened; the rest is left to Spark."""
        for f in filters:
            attribute = getattr(f, "attribute", None)
            if attribute == (self.source.key,) and isinstance(f, EqualTo | In | StringStartsWith):
                test = (lambda k, v=f.value: k == v) if isinstance(f, EqualTo) else (lambda k, v=f.value: k in v) if isinstance(f, In) else (lambda k, v=f.value: k.startswith(v))
                old = self.kept
                self.kept = test if old is None else (lambda k, a=old, b=test: a(k) and b(k))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = self.source.files()
        if self.kept is not None:
            files = [f for f in files if self.kept(self.source.key_of(f[0]))]
        return _dealt(files, self.source.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.source.batches(partition.names)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time of change of the newest file that was taken; a
    file that changes comes again."""

    def __init__(self, source: _Tree):
        self.source = source

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": max((f[2] for f in self.source.files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in self.source.files() if start["at"] < f[2] <= end["at"]], self.source.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.source.batches(partition.names)


class _Tree(DataSource):
    """Files under the option `path`, dealt by size; `partitionBytes` says how
    much a partition reads."""

    ending, key, fields = "", "path", ""

    def __init__(self, options: dict):
        super().__init__(options)
        self.root, self.most = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def schema(self) -> str:
        return self.fields

    def files(self) -> list[tuple[str, int, int]]:
        return _listed(self.root, self.ending)

    def key_of(self, name: str) -> str:
        return name

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self)

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def batches(self, names: list[str], most: int = 10_000) -> Iterator[pa.RecordBatch]:
        """A file at a time, its rows in batches."""
        store, root = _store(self.root)
        for name in names:
            with store.open_input_stream(posixpath.join(root, name)) as f:
                data = f.read()
            held = []
            for row in self.rows(name, data):
                held.append(row)
                if len(held) == most:
                    yield self.batch(held)
                    held = []
            if held:
                yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
        named = [f.split(" ") for f in self.fields.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named])


class Notes(_Tree):
    """path under the root, data, size."""

    ending, fields = ".md", "path string, data binary, size long"

    @classmethod
    def name(cls) -> str:
        return "quern_notes"

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        yield name, data, len(data)


class Transcripts(_Tree):
    """Lines of transcripts: session_id (the file's name), line, value."""

    ending, key, fields = ".jsonl", "session_id", "session_id string, line long, value string"

    @classmethod
    def name(cls) -> str:
        return "quern_transcripts"

    def key_of(self, name: str) -> str:
        return posixpath.basename(name).removesuffix(self.ending)

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        for i, line in enumerate(data.decode("utf-8", "replace").split("\n")):
            if line.strip():
                yield self.key_of(name), i, line


class Commits(_Tree):
    """Changed files of commit exports, as `git log --raw --no-renames
    --no-abbrev --first-parent --format=%H` writes them: file, commit_sha,
    path, old_blob, new_blob (null where there is none)."""

    ending, key, fields = ".log", "file", "file string, commit_sha string, path string, old_blob string, new_blob string"

    @classmethod
    def name(cls) -> str:
        return "quern_commits"

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        sha = None
        for line in data.decode("utf-8", "replace").split("\n"):
            if line.startswith(":"):
                head, _, path = line.partition("\t")
                old, new = (None if set(b) == {"0"} else b for b in head.split(" ")[2:4])
                yield name, sha, path, old, new
            elif len(line) == 40 and set(line) <= set("0123456789abcdef"):
                sha = line


class CausalEdges(_Tree):
    """Causal edges from JSON lines: file, session_id, event_order, edge_id,
    dst, dst_type, pair_cut_sha; a line that is no object is an error."""

    ending, key, fields = ".edges.jsonl", "file", "file string, session_id string, event_order long, edge_id string, dst string, dst_type string, pair_cut_sha string"

    @classmethod
    def name(cls) -> str:
        return "quern_causal_edges"

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        import json

        for line in data.decode("utf-8").split("\n"):
            if line.strip():
                row = json.loads(line)
                yield name, row["session_id"], int(row["event_order"]), row["edge_id"], row["dst"], row["dst_type"], row.get("pair_cut_sha")


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Notes, Transcripts, Commits, CausalEdges):
        spark.dataSource.register(source)


def work_list(commits: DataFrame) -> DataFrame:
    """(path, blob) once each of a commit export's rows, with the first
    commit that has them by sha: what is to be read of a ledger."""
    return commits.where("new_blob IS NOT NULL").groupBy("path", F.col("new_blob").alias("blob")).agg(F.min("commit_sha").alias("commit_sha"))
