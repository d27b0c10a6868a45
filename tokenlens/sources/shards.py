"""Binary token shards and compressed JSON lines as Spark data sources, with a digest of every file and a manifest.

    register(spark)
    df.write.format("token_shards").option("shardSize", 1 << 27).mode("append").save(path)      # (split, doc_id, ids)
    df.write.format("jsonl_shards").option("shardSize", 1 << 28).mode("append").save(path)      # (split, id, text)
    spark.read.format("token_shards").load(path)

A task writes the rows that it has, in their order, so sort and partition as the files shall be. Files of the split `train` are rotated: the document that
takes one to shardSize (tokens, or bytes of JSON) is its last. Other splits have one file a task. Files go to names of their own under
_parts and are moved when all tasks have succeeded; then the manifest is written, and readers go by it alone. A task that fails deletes
its parts, and so does the driver where a write is given up. Paths are any that pyarrow.fs knows, on a file system that all machines share.

A token shard is {split}-{n}.bin, ids as little-endian unsigned 32-bit numbers, and {split}-{n}.idx, for each document its doc_id and where it ends, as
64-bit numbers. JSON lines are {split}-{n}.jsonl.zst. An empty or missing text, or list of ids, is a document like others; a null doc_id is an error.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROTATED, MANIFEST, PARTS = "train", "manifest.json", "_parts"


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def manifest_of(path: str) -> list[dict]:
    """The files of a path, in order: name, split, n_docs, n_units, n_bytes, sha256."""
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list


class Part:
    """One file in the making: bytes are hashed as they are written."""

    def __init__(self, fs: pa.fs.FileSystem, name: str):
        self.fs, self.name, self.hash, self.n_bytes = fs, name, sha256(), 0
        self.out = fs.open_output_stream(name)

    def write(self, raw: bytes) -> int:
        self.out.write(raw)
        self.hash.update(raw)
        self.n_bytes += len(raw)
        return len(raw)

    def close(self) -> dict:
        self.out.close()
        return {"part": self.name, "n_bytes": self.n_bytes, "sha256": self.hash.hexdigest()}


class TokenFile:
    endings = (".bin", ".idx")

    def __init__(self, fs: pa.fs.FileSystem, name: str):
        self.tokens, self.index = (Part(fs, name + e) for e in self.endings)
        self.size = self.n_docs = 0

    def add(self, row: dict) -> None:
        if row["doc_id"] is None:
            raise ValueError("a document without doc_id")
        ids = np.asarray(row["ids"] if row["ids"] is not None else [], np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
            raise ValueError(f"ids of document {row['doc_id']} don't fit 32 bits")
        self.tokens.write(ids.astype("<u4").tobytes())
        self.size += len(ids)
        self.n_docs += 1
        self.index.write(np.array([row["doc_id"], self.size], "<i8").tobytes())

    def close(self) -> list[dict]:
        return [self.tokens.close(), self.index.close()]


class JsonFile:
    endings = (".jsonl.zst",)

    def __init__(self, fs: pa.fs.FileSystem, name: str):
        self.part = Part(fs, name + self.endings[0])
        self.packed = zstandard.ZstdCompressor(level=3).stream_writer(self.part, closefd=False)
        self.size = self.n_docs = 0

    def add(self, row: dict) -> None:
        line = (json.dumps({"id": row["id"], "text": row["text"]}, ensure_ascii=False) + "\n").encode()
        self.packed.write(line)
        self.size += len(line)
        self.n_docs += 1

    def close(self) -> list[dict]:
        self.packed.close()
        return [self.part.close()]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int, kind: type, overwrite: bool):
        self.path, self.size, self.kind, self.overwrite, self.job = path, size, kind, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, root = filesystem(self.path)
        folder = f"{root}/{PARTS}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        open_, done = {}, []

        def finish(split: str) -> None:
            file = open_.pop(split)
            done.append({"split": split, "n_docs": file.n_docs, "n_units": file.size, "order": (context.partitionId(), len(done)), "parts": file.close()})

        fs.create_dir(folder)
        try:
            for batch in batches:
                for k in range(batch.num_rows):  # a row at a time: a document may be long
                    row = batch.slice(k, 1).to_pylist()[0]
                    split = row["split"] or ROTATED
                    if split not in open_:
                        open_[split] = self.kind(fs, f"{folder}/{len(done)}-{len(open_)}-{split}")
                    open_[split].add(row)
                    if split == ROTATED and open_[split].size >= self.size:
                        finish(split)
            for split in list(open_):
                finish(split)
        except BaseException:
            for file in open_.values():
                file.close()
            fs.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        old = manifest_of(self.path)
        files = [] if self.overwrite else list(old)
        taken = {f["name"] for f in old}
        number: dict[str, int] = {}
        for file in sorted((f for m in messages if m for f in m.files), key=lambda f: f["order"]):
            split = file["split"]
            while (stem := f"{split}-{number.get(split, 0):05d}") + self.kind.endings[0] in taken:
                number[split] = number.get(split, 0) + 1
            number[split] = number.get(split, 0) + 1
            for part, ending in zip(file["parts"], self.kind.endings):
                fs.move(part["part"], f"{root}/{stem}{ending}")
                files.append({"name": stem + ending, "split": split, "n_docs": file["n_docs"], "n_units": file["n_units"], "n_bytes": part["n_bytes"], "sha256": part["sha256"]})
        beside = f"{root}/{PARTS}/{self.job}-{MANIFEST}"
        with fs.open_output_stream(beside) as out:
            out.write(json.dumps({"files": sorted(files, key=lambda f: f["name"])}, indent=1, sort_keys=True).encode())
        fs.move(beside, f"{root}/{MANIFEST}")  # from here on readers see the new files
        if self.overwrite:
            for f in old:
                fs.delete_file(f"{root}/{f['name']}")
        fs.delete_dir(f"{root}/{PARTS}")

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/{PARTS}/{self.job}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{PARTS}/{self.job}")
            if not fs.get_file_info(pa.fs.FileSelector(f"{root}/{PARTS}")):
                fs.delete_dir(f"{root}/{PARTS}")


class ShardReader(DataSourceReader):
    """A partition per file; its digest is compared when it has been read to its end."""

    def __init__(self, path: str, kind: type):
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        files = {f["name"]: f for f in manifest_of(self.path)}
        names = [n for n in files if n.endswith(self.kind.endings[0])]
        return [InputPartition((n, *(files[n.removesuffix(self.kind.endings[0]) + e] for e in self.kind.endings))) for n in sorted(names)]

    def raw(self, file: dict) -> bytes:
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/{file['name']}") as stream:
            raw = stream.read()
        if sha256(raw).hexdigest() != file["sha256"]:
            raise ValueError(f"{file['name']} is not what was written")
        return raw


class TokenReader(ShardReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        _, tokens, index = partition.value
        ids = np.frombuffer(self.raw(tokens), "<u4").astype(np.int64)
        rows = np.frombuffer(self.raw(index), "<i8").reshape(-1, 2)
        starts = np.concatenate([[0], rows[:, 1]])
        for a in range(0, len(rows), 1024):
            own = rows[a : a + 1024]
            base = starts[a]
            offsets = pa.array(starts[a : a + len(own) + 1] - base, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids[base : own[-1, 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([tokens["split"]] * len(own)), pa.array(own[:, 0]), lists], ["split", "doc_id", "ids"])


class JsonReader(ShardReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        _, file = partition.value
        lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(self.raw(file)), read_across_frames=True), encoding="utf-8", newline="\n")
        rows: list[dict] = []
        for line in lines:
            rows.append({"split": file["split"], **json.loads(line)})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=_JSON)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_JSON)


_JSON = pa.schema([("split", pa.string()), ("id", pa.string()), ("text", pa.string())])


class _Shards(DataSource):
    columns, file, read_by = "", TokenFile, TokenReader

    def path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("shards need a path")
        return self.options["path"]

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.read_by(self.path(), self.file)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c.split()[0] for c in self.columns.split(", ") if c.split()[0] not in schema.names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        return ShardWriter(self.path(), int(self.options.get("shardSize", 1 << 27)), self.file, overwrite)


class TokenShards(_Shards):
    columns = "split string, doc_id bigint, ids array<bigint>"

    @classmethod
    def name(cls) -> str:
        return "token_shards"


class JsonShards(_Shards):
    columns, file, read_by = "split string, id string, text string", JsonFile, JsonReader

    @classmethod
    def name(cls) -> str:
        return "jsonl_shards"


def register(spark: SparkSession) -> None:
    for source in (TokenShards, JsonShards):
        spark.dataSource.register(source)
