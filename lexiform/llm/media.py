"""Media columns: archives of images behind a data source that plans byte ranges and retries members by offset."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiform.llm.common import documents, new_path, slices, written

#: Samples in a row of the image; payloads are padded to a multiple of it.
WIDTH = 64
#: An archive is closed once it holds this many bytes; a read task covers this many.
ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
#: Reads of one member before it is given up, and members in an Arrow batch's bytes.
TRIES, BATCH_BYTES = 4, 1 << 20
MANIFEST = "_MANIFEST.json"
#: Fixed value: the signature of a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (WIDTH if not data else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image of WIDTH samples a row; the unpadded length stands in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 in front of each row
    raw[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"Bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image from ``to_png``; every chunk's checksum is tested."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, n, high = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            high = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(high, WIDTH + 1)
    return raw[:, 1:].tobytes(), n


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(rows: DataFrame, folder: str) -> None:
    """Writes rows of (name, text) as images in ZIP archives under ``folder``, then a manifest of the archives that count.

    Each task fills archives of its own and writes each in one go under a fresh name, so a task that is run again
    leaves at worst an archive that the manifest doesn't list. Null texts are stored as empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        made: list[tuple[str, int, int]] = []
        buf, n = io.BytesIO(), 0
        z = zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED)

        def close() -> None:
            z.close()
            if n:
                name = f"{uuid.uuid4().hex}.zip"
                with files.open_output_stream(f"{at}/{name}") as out:
                    out.write(buf.getbuffer())
                made.append((name, buf.tell(), n))

        for b in slices(batches):
            for name, text in zip(b.column(0), b.column(1), strict=True):
                data = (text.as_py() or "").encode()
                info = zipfile.ZipInfo(f"{n}/{'' if name.as_py() is None else name.as_py()}")
                z.writestr(info, to_png(padded(data), len(data)))
                n += 1
                if buf.tell() >= ARCHIVE_BYTES:
                    close()
                    buf, n = io.BytesIO(), 0
                    z = zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "size", "members"])

    made = written(rows.select(F.col("name").cast("string"), "text").mapInArrow(run, "name string, size long, members long"), "media-manifest")
    files, at = filesystem(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/{MANIFEST}") as out:
        out.write(json.dumps([[r.name, r.size] for r in made.collect()]).encode())


class Range(InputPartition):
    """The members of one archive whose headers start in [start, end)."""

    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


def members(source, size: int) -> list[tuple[str, int, int, int]]:
    """(name, header offset, stored size, crc) of an archive's members, from its central directory."""

    class Tail(io.RawIOBase):
        at = 0

        def seekable(self):
            return True

        def readable(self):
            return True

        def seek(self, to, how=0):
            self.at = to + (self.at if how == 1 else size if how == 2 else 0)
            return self.at

        def tell(self):
            return self.at

        def read(self, n=-1):
            got = source.read_at(size - self.at if n < 0 else min(n, size - self.at), self.at)
            self.at += len(got)
            return got

    with zipfile.ZipFile(Tail()) as z:
        return [(i.filename, i.header_offset, i.compress_size, i.CRC) for i in z.infolist()]


def read_member(files, path: str, source, offset: int, size: int, crc: int, tries: int = TRIES) -> tuple[bytes | None, str | None]:
    """(bytes, None) of the member whose local header stands at ``offset``, or (None, error) after ``tries`` reads.

    A short or corrupt read or an error of the store is tried again for this member alone, from a fresh handle.
    """
    error = None
    for k in range(tries):
        try:
            handle = source if k == 0 else files.open_input_file(path)
            head = handle.read_at(30, offset)
            data = handle.read_at(size, offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
            if head[:4] == b"PK\x03\x04" and len(data) == size and zlib.crc32(data) == crc:
                return data, None
            error = "corrupt member"
        except (OSError, struct.error) as e:
            error = str(e) or type(e).__name__
    return None, error


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.span = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        files, at = filesystem(self.folder)
        if files.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
            with files.open_input_file(f"{at}/{MANIFEST}") as f:
                found = json.loads(f.read())
        else:
            found = [[i.base_name, i.size] for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".zip")]
        return [Range(f"{at}/{name}", size, a, min(size, a + self.span)) for name, size in sorted(found) for a in range(0, size, self.span)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = filesystem(self.folder)
        rows: list[tuple] = []
        with files.open_input_file(partition.path) as source:
            held = 0
            for name, offset, size, crc in members(source, partition.size):
                if partition.start <= offset < partition.end:
                    data, error = read_member(files, partition.path, source, offset, size, crc)
                    rows.append((name.partition("/")[2] or None, offset, data, error))
                    held += size
                    if held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["name", "member_offset", "media", "error"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: name, member_offset, media, error for each member.

    Partitions are byte ranges of the archives (option rangeBytes). A member that can't be read has a null
    media and its error; the others of its range are unaffected. An empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "name string, member_offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def feature(payload: bytes) -> str:
    """Rows, mean, spread and an 8 x 8 average hash of an image."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    edge = np.linspace(0, len(x), 9).astype(int)
    rows = np.add.reduceat(x, np.minimum(edge[:-1], len(x) - 1), axis=0, dtype=np.int64)
    cells = rows.reshape(8, 8, 8).sum(2) / np.maximum(1, np.diff(edge))[:, None]
    bits = "".join("1" if b else "0" for b in (cells > cells.mean()).ravel())
    return f"rows={len(x)} mean={int(x.mean() * 1000)} sd={int(x.std() * 1000)} hash={int(bits, 2):016x}"


def described(media: DataFrame) -> DataFrame:
    """name, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error of each member.

    A member that could not be read or decoded has nulls and its error.
    """
    names = ["name", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for name, media, error in zip(*(b.column(i) for i in range(3)), strict=True):
                data, why = media.as_py(), error.as_py()
                try:
                    payload, n = from_png(data) if data is not None else (None, None)
                except (ValueError, zlib.error, struct.error) as e:
                    payload, why = None, str(e)
                rows.append((name.as_py(), *((None,) * 7 if payload is None else (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))), why))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return media.select("name", "media", "error").mapInArrow(run, "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the media columns of every document; a null text counts as empty, rows that repeat count each, an empty table gives an empty result."""
    folder = new_path(spark, "media")
    write_archives(documents(spark, sf_dir).select(F.col("doc_id").alias("name"), "text"), folder)
    spark.dataSource.register(MediaArchives)
    out = described(spark.read.format("media_archives").load(folder))
    return out.select(F.col("name").cast("long").alias("doc_id"), *[c for c in out.columns if c != "name"])
