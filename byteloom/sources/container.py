"""The framed container as a Spark data source: one partition per file, one row per block.

Layout, little-endian: magic "PZ", version 2, pipeline number, original length (4 bytes), number of blocks
(4 bytes: 0xFFFFFFFF marks frames). Then for each frame its coded and original length (4 bytes each), the CRC-32 of
the original (4 bytes: this container's own addition) and the payload; a coded length of 0 ends the stream.
Table mode instead has the number of blocks and all (coded, original, CRC) triples before the payloads.

Reader: spark.read.format("byteloom_container").load(folder). Writer: df.write.format("byteloom_container").
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, VERSION, FRAMED, LARGEST = b"PZ", 2, 0xFFFFFFFF, 0xFFFFFFFF
SCHEMA = "path string, block_idx int, pipeline int, original_len long, crc long, payload binary"


class BadContainer(ValueError):
    """The bytes are no container, or not a whole one."""


def filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def pack(pipeline: int, frames: list[tuple[int, int, bytes]], table: bool = False) -> bytes:
    """A container of (original_len, crc, payload) frames."""
    whole = sum(n for n, _, _ in frames)
    if whole > LARGEST:
        raise BadContainer("more than 4 GiB in one container")
    head = MAGIC + struct.pack("<BBI", VERSION, pipeline, whole)
    if table:
        return b"".join([head, struct.pack("<I", len(frames)), *(struct.pack("<III", len(p), n, c) for n, c, p in frames), *(p for _, _, p in frames)])
    return b"".join([head, struct.pack("<I", FRAMED), *(struct.pack("<III", len(p), n, c) + p for n, c, p in frames), struct.pack("<I", 0)])


def unpack(stream) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(block_idx, pipeline, original_len, crc, payload) of a container, read frame by frame."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) < n:
            raise BadContainer("the container is cut off")
        return bytes(data)

    if take(2) != MAGIC:
        raise BadContainer("no container magic")
    version, pipeline, whole = struct.unpack("<BBI", take(6))
    if version != VERSION:
        raise BadContainer(f"version {version}")
    (number,) = struct.unpack("<I", take(4))
    seen = k = 0
    if number == FRAMED:
        while coded := struct.unpack("<I", take(4))[0]:
            n, crc = struct.unpack("<II", take(8))
            yield k, pipeline, n, crc, take(coded)
            seen, k = seen + n, k + 1
    else:
        entries = [struct.unpack("<III", take(12)) for _ in range(number)]
        if sum(n for _, n, _ in entries) != whole:
            raise BadContainer("block lengths don't add up")
        for k, (coded, n, crc) in enumerate(entries):
            yield k, pipeline, n, crc, take(coded)
        return
    if seen != whole:
        raise BadContainer("block lengths don't add up")


class Container(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byteloom_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = filesystem(self.path)
        info = files.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        return [InputPartition(x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(".pz")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = filesystem(self.path)
        with files.open_input_stream(partition.value) as stream:
            for frame in unpack(stream):
                yield (partition.value, *frame)


class _Writer(DataSourceWriter):
    """Rows are block_idx, pipeline, original_len, crc, payload, ordered within their task; one file per task."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.table = options["path"], options.get("mode", "framed") == "table"
        files, at = filesystem(self.path)
        from pyarrow import fs

        if files.get_file_info(at).type != fs.FileType.NotFound:
            if not overwrite:
                raise BadContainer(f"{self.path} is there already")
            files.delete_dir(at)
        files.create_dir(at, recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        frames, pipeline = [], 0
        for r in iterator:
            pipeline = r["pipeline"]
            frames.append((r["original_len"], r["crc"], bytes(r["payload"])))
        name = f"part-{uuid.uuid4().hex}.pz"
        if frames:
            files, at = filesystem(self.path)
            with files.open_output_stream(f"{at}/{name}.tmp") as out:
                out.write(pack(pipeline, frames, self.table))
        return _Done(name if frames else "")

    def commit(self, messages: list) -> None:
        files, at = filesystem(self.path)
        for m in messages:
            if m and m.name:
                files.move(f"{at}/{m.name}.tmp", f"{at}/{m.name}")

    def abort(self, messages: list) -> None:
        files, at = filesystem(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{at}/{m.name}.tmp")


class _Done(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Container)
