"""Media columns: a Spark data source over ZIP archives of media members.

Writing: each task streams members into archives of bounded size; the commit step writes a manifest
of the archives of successful tasks, so files of failed or repeated attempts are never read.
Reading: the driver lists the manifest only and plans byte ranges over the archives. A task opens
its archive's directory, takes the members whose local header starts inside its range, and streams
payloads in Arrow batches of bounded size. A member that can't be read (I/O error, bad header, CRC)
is read again by its own offset on a fresh handle, without touching the others.
Paths go through pyarrow's file systems: file, HDFS, S3 and GCS URIs.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from reelquarry.llm.common import documents, prepare, shared_path

FORMAT = "media_archive"
#: Bytes of members after which a writer begins another archive.
ROLL_BYTES = 64 << 20
#: Bytes of archive that a read task takes.
SPLIT_BYTES = 16 << 20
#: Bytes of payload in a batch.
BATCH_BYTES = 4 << 20
RETRIES = 3
_LOCAL_HEADER = struct.Struct("<4s5H3L2H")
_READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class MemberError(Exception):
    pass


def read_member(handle, info: zipfile.ZipInfo) -> bytes:
    """The payload of one member, found by its offset and verified against its CRC."""
    handle.seek(info.header_offset)
    head = handle.read(_LOCAL_HEADER.size)
    if len(head) < _LOCAL_HEADER.size or head[:4] != b"PK\x03\x04":
        raise MemberError("no local header at the offset")
    name_len, extra_len = _LOCAL_HEADER.unpack(head)[-2:]
    handle.seek(info.header_offset + _LOCAL_HEADER.size + name_len + extra_len)
    raw = handle.read(info.compress_size)
    data = raw if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise MemberError("size or CRC differs")
    return data


@dataclass
class ArchiveRange(InputPartition):
    archive: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.fail = options.get("onerror", "fail") == "fail"

    def partitions(self) -> list[ArchiveRange]:
        fs, root = _open_fs(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("_manifest-"):
                with fs.open_input_file(info.path) as f:
                    found += json.loads(f.read())
        ranges = [ArchiveRange(f"{root}/{name}", at, at + self.split) for name, size in found for at in range(0, size, self.split)]
        return ranges or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = _open_fs(self.path)
        handle = fs.open_input_file(partition.archive)
        rows, held = [], 0
        with zipfile.ZipFile(handle) as directory:
            members = [m for m in directory.infolist() if partition.start <= m.header_offset < partition.end]
        for member in sorted(members, key=lambda m: m.header_offset):
            data, error = None, None
            for attempt in range(self.retries + 1):
                try:
                    if attempt or handle.closed:
                        handle = fs.open_input_file(partition.archive)
                    data, error = read_member(handle, member), None
                    break
                except (OSError, MemberError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
            if error and self.fail:
                raise MemberError(f"{partition.archive} at {member.header_offset}: {error}")
            rows.append((partition.archive, member.header_offset, member.filename, data, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


@dataclass
class _Written(WriterCommitMessage):
    archives: list


class _Writer(DataSourceArrowWriter):
    """Takes rows (name string, media binary)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("rollbytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        done, archive, stream, name, size = [], None, None, "", 0

        def close():
            archive.close()
            stream.close()
            done.append((name, fs.get_file_info(f"{root}/{name}").size))

        for batch in iterator:
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    name, size = f"part-{uuid.uuid4().hex}.zip", 0
                    stream = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                archive.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), media, zipfile.ZIP_DEFLATED, 1)
                size += len(media)
                if size >= self.roll:
                    close()
                    archive = None
        if archive is not None:
            close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        for name in (a[0] for m in messages if m for a in m.archives):
            fs.delete_file(f"{root}/{name}")


class MediaArchive(DataSource):
    """`spark.read.format("media_archive").load(folder)`; options splitBytes, retries, onError=fail|null."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()})


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload's bytes."""
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file, found by its chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise MemberError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise MemberError("no samples")


def feature(payload: bytes) -> str:
    """Level, spread, zero-crossing rate and peak of the signal, and its eight-bin level histogram."""
    x = np.frombuffer(payload, np.uint8)
    up = x >= 128
    counts = np.bincount(x >> 5, minlength=8)
    crossings = np.count_nonzero(up[1:] != up[:-1])
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    n = len(x)
    spread = (square / n - (total / n) ** 2) ** 0.5
    return f"mean={total / n:.4f};std={spread:.4f};zcr={crossings / max(n - 1, 1):.6f};peak={int(x.max())};hist=" + ",".join(map(str, counts.tolist()))


def pack_texts(docs: DataFrame, path: str) -> None:
    """Stores each text (null: empty), padded with zero bytes to a positive multiple of 64, as a WAV member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            names, media, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                names.append(f"{n:08d}/{'null' if doc_id is None else doc_id}/{len(data)}.wav")
                media.append(wav(data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))))
                n, held = n + 1, held + len(media[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["name", "media"])
                    names, media, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["name", "media"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "name string, media binary")
    rows.write.format(FORMAT).mode("append").save(path)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    for batch in batches:
        rows = []
        for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, doc_id, size = name.removesuffix(".wav").split("/")
            payload = samples(media)
            rows.append(
                (
                    None if doc_id == "null" else int(doc_id),
                    int(size),
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-64:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature(payload),
                )
            )
        if rows:
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the archive and back, with digests and signal features of what was read.

    Null text is stored as 64 zero bytes with n_bytes 0; repeated rows and ids stay separate members.
    An empty table gives no rows. The archives lie in the shared folder and belong to the caller.
    """
    prepare(spark)
    spark.dataSource.register(MediaArchive)
    path = shared_path(spark, "media")
    pack_texts(documents(spark, sf_dir), path)
    return spark.read.format(FORMAT).load(path).select(F.col("name"), F.col("media")).mapInArrow(describe, _OUT)
