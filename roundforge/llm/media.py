"""Media columns: payloads as members of archives, read by a Spark data source by byte range.

Writing: each text's UTF-8 bytes, padded with zeros to a multiple of 64, become an 8-bit grey PNG of width 64, a lossless
member of a ZIP archive (members are stored, the directory comes last). A task writes archives of bounded size to the shared folder, under
names that only depend on its partition, by renaming a finished file: a task that runs again replaces its own files.

Reading: the source ``roundforge_archive`` lists the archives and plans partitions of byte ranges over them. A partition reads
the directories of its archives and takes the members that begin in its ranges, each by a read at its own offset, checked by
its CRC and retried alone. Payloads go to Spark as Arrow batches of bounded size.

Defined cases: a null text is empty and has 64 zero bytes; equal texts have equal bytes and features; a null doc_id comes back as null; repeated
rows are members of their own; a text of any length is one member, and a task holds one member, as text, samples and PNG, beside the archive that
it fills (archive_bytes) or the batch that it returns (BATCH_BYTES); an empty table gives no archives and no rows; extra columns, also
those named like a result, are ignored.

Paths may name any store that Arrow opens, in Hadoop's spelling too (s3a, wasbs, dbfs); any other scheme goes through Hadoop's own library.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roundforge.llm.common import as_text, in_arrow, map_texts, scratch, slices, written
from roundforge.sources.stores import opened

WIDTH = 64
ARCHIVE_BYTES = 32_000_000
RANGE_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
ATTEMPTS = 4
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The samples, a row for each line."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, idat, width = 8, [], 0
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:]


# --- writing -----------------------------------------------------------------------------------


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores the texts of ``docs`` (doc_id, text); returns a row for each archive: name, bytes, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        part, done = TaskContext.get().partitionId(), []
        buffer, archive, members = io.BytesIO(), None, 0

        def close() -> None:
            nonlocal buffer, archive, members
            archive.close()
            name = f"{root}/part-{part:06d}-{len(done):05d}.zip"
            draft = f"{root}/.draft-{part:06d}-{len(done):05d}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(buffer.getbuffer())
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(draft, name)
            done.append((name, buffer.tell(), members))
            buffer, archive, members = io.BytesIO(), None, 0

        for b in (x for batch in batches for x in slices(batch, "_text")):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if archive is None:
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                payload, n = payload_of(text)
                info = zipfile.ZipInfo(f"{members:08d}_{'' if doc is None else doc}_{n}.png", (1980, 1, 1, 0, 0, 0))
                archive.writestr(info, png(payload))
                members += 1
                if buffer.tell() >= archive_bytes:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "bytes", "members"])

    rows = docs.select("doc_id", as_text().alias("_text"))
    return written(in_arrow(rows, run, "name string, bytes long, members long"), "archives")


# --- reading -----------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """Byte ranges (archive, from, to) of one partition."""

    parts: list[tuple[str, int, int]]


def plan(archives: list[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """Ranges of about range_bytes: large archives are cut, small ones share a partition."""
    out, now, size = [], [], 0
    for name, total in archives:
        for lo in range(0, max(total, 1), range_bytes):
            hi = min(lo + range_bytes, total)
            if now and size + hi - lo > range_bytes:
                out.append(Ranges(now))
                now, size = [], 0
            now.append((name, lo, hi))
            size += hi - lo
    return [*out, Ranges(now)] if now else out


def read_member(archive: pa.NativeFile, info: zipfile.ZipInfo, attempts: int = ATTEMPTS, reopen: Callable[[], pa.NativeFile] | None = None) -> bytes:
    """A member's bytes by its offset; reads again, this member only and through a new handle, if they are damaged or can't be read."""
    for k in range(attempts):
        try:
            if k and reopen is not None:
                archive = reopen()
            head = archive.read_at(30, info.header_offset)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member begins here")
            name, extra = struct.unpack_from("<HH", head, 26)
            data = archive.read_at(info.compress_size, info.header_offset + 30 + name + extra)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError("the member is damaged")
            return data
        except (OSError, ValueError, struct.error):
            if k + 1 == attempts:
                raise
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return plan(sorted((f.path, f.size) for f in found if f.path.endswith(".zip")), self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows: list[tuple] = []
        size = 0
        for name, lo, hi in partition.parts:
            with store.open_input_file(name) as archive:
                for info in zipfile.ZipFile(archive).infolist():
                    if lo <= info.header_offset < hi:
                        _, doc, n = info.filename.removesuffix(".png").split("_")
                        data = read_member(archive, info, reopen=lambda name=name: store.open_input_file(name))
                        rows.append((int(doc) if doc else None, int(n), name.rsplit("/", 1)[-1], info.header_offset, data))
                        size += len(data)
                        if size >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """Options: path (a folder of archives, a URI), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "roundforge_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("roundforge_archive").option("rangeBytes", range_bytes).load(path)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(samples: np.ndarray) -> str:
    """Lines, mean, deviation and entropy of the samples, and a hash of which of 64 bands are brighter than the next."""
    flat = samples.reshape(-1)
    share = np.bincount(flat, minlength=256) / len(flat)
    seen = share[share > 0]
    entropy = -(seen * np.log2(seen)).sum()
    mean = samples.mean(0)
    bits = np.packbits(mean > np.roll(mean, -1)).tobytes().hex()
    return f"lines={len(samples)};mean={flat.mean():.4f};std={flat.std():.4f};entropy={abs(entropy):.4f};bands={bits}"


def features(media: DataFrame) -> DataFrame:
    """``media`` with FEATURES in place of the bytes."""

    def run(blobs: list[bytes]) -> dict[str, list]:
        rows = []
        for blob in blobs:
            samples = unpng(blob)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(samples)))
        names = [f.split()[0] for f in FEATURES.split(", ")]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_texts(media, run, FEATURES, column="media")


def media_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores the texts of ``docs`` and reads them back: doc_id, n_bytes, archive, offset and FEATURES."""
    spark = docs.sparkSession
    path = path or scratch(spark, "media")
    write_archives(docs, path).agg(F.sum("members")).collect()
    return features(read_archives(spark, path))
