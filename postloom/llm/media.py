"""Media columns: content-addressed payloads in tar shards.

Each task appends the distinct payloads it meets to tar shards in the shared folder and
hands on rows of digest, shard, offset and length; no payload is shuffled. Metadata comes
from range reads of the headers, features from range reads of whole payloads, each distinct
digest once.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import keep, partitions, shared_folder

WIDTH, HEADER, SHARD_BYTES = 576, 33, 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format

INDEX = "digest string, shard string, offset long, length long"


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the width."""
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """The payload as rows of 8-bit grey samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a stored payload")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> np.ndarray:
    width, height, _ = png_header(media[:HEADER])
    at, body = HEADER, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body += media[at + 8 : at + 8 + n]
        at += n + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that is not written here")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit average hash of 8 x 8 cells."""
    x = samples.astype(np.float64)
    rows = np.add.reduceat(x.mean(axis=1), np.arange(8) * len(x) // 8) if len(x) >= 8 else np.resize(x.mean(axis=1), 8)
    cells = x.mean(axis=0).reshape(8, -1).mean(axis=1)
    bits = (np.add.outer(rows, cells) > np.add.outer(rows, cells).mean()).ravel()
    return f"mean={x.mean():.4f};sd={x.std():.4f};ahash={np.packbits(bits).tobytes().hex()}"


class _Shards:
    """Tar shards of one task; the attempt is in the name, so a retry never writes over what another attempt left."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(f"{folder}/tar")
        self.fs.create_dir(self.root, recursive=True)
        task = TaskContext.get()
        self.stem = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "driver-0"
        self.count, self.out = 0, None

    def add(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at, self.known = f"{self.stem}-{self.count:04d}.tar", 0, {}
            self.out, self.count = self.fs.open_output_stream(f"{self.root}/{self.name}"), self.count + 1
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512))
            self.known[digest] = (self.name, self.at + 512, len(media))
            self.at += 512 + len(media) + -len(media) % 512
        found = self.known[digest]
        if self.at > SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store_texts(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) for each row of docs (doc_id, text): where its text's payload was put.

    Null text counts as empty; its payload is one row of padding. The digest is the
    SHA-256 of the stored form, so equal texts have equal digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        try:
            for batch in batches:
                for k in range(0, len(batch), 200):
                    part = batch.slice(k, 200)
                    rows = []
                    for text in part.column("text"):
                        raw = (text.as_py() or "").encode()
                        media = to_png(padded(raw))
                        digest = hashlib.sha256(media).hexdigest()
                        rows.append((len(raw), digest, *shards.add(digest, media)))
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64())] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_bytes long, {INDEX}")


def _ranges(index: DataFrame, folder: str, read: int | None, made: str, names: list[str], use: Callable[[bytes], tuple]) -> DataFrame:
    """Adds what `use` makes of each row's range, or of its first `read` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{folder}/tar")
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                rows.append(use(file.read_at(length if read is None else min(read, length), offset)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in columns)], names=[*batch.schema.names, *names])

    have = ", ".join(f"{c} {t}" for c, t in index.dtypes)
    return index.mapInArrow(run, f"{have}, {made}")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth by reading 33 bytes of each payload."""
    return _ranges(index, folder, HEADER, "width long, height long, bit_depth long", ["width", "height", "bit_depth"], lambda head: tuple(map(int, png_header(head))))


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Adds digests and features of the payloads as read back."""

    def use(media: bytes) -> tuple:
        samples = from_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _ranges(index, folder, None, made, [x.split()[0] for x in made.split(", ")], use)


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length and the metadata and feature columns for each row of docs (doc_id, text).

    Rows of equal texts are all led to one stored payload. Repeated rows and null ids come
    back as they are.
    """
    folder = shared_folder(spark)
    stored = keep(store_texts(docs, folder), f"{folder}/index")
    place = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")
    place = place.repartition(partitions(spark), "shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")
    known = keep(read_features(read_headers(place, folder), folder), f"{folder}/features")
    return stored.select("doc_id", "n_bytes", "digest").join(known, "digest")
