"""Token ids as bit-plane or byte-plane shuffled shard files with a chunk index.

File of a shard (little-endian)::

    "TPL1" | chunk ... | doc index | chunk index | u64 place of the doc index | u64 place of the chunk index | "TPL1"

* A chunk holds ``block`` ids (the last one fewer). The ids are transposed into
  four byte planes or thirty-two bit planes, and each plane is compressed alone:
  high planes are nearly constant and shrink to almost nothing.
* The doc index has, in order, doc_id (i64), a null flag (u8) and the number of
  ids (u32) of each document, as one zstandard frame.
* The chunk index has, per chunk, its place (u64), its number of ids (u32) and
  the compressed size of each plane (u32).

Any chunk can be read alone. Executors write the files with ``pyarrow.fs``
straight into the shared folder under a name of their own attempt, and Spark
commits the manifest that names them: a lost or repeated task leaves at most a
file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.llm.text import token_ids
from netpulse.session import fresh_folder

MAGIC = b"TPL1"
BLOCK = 65_536
PLANES = {"byte": 4, "bit": 32}
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def shuffle_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Ids (u32) transposed into byte planes or bit planes, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [plane.tobytes() for plane in raw]
    return [np.packbits((plane >> b) & 1).tobytes() for plane in raw for b in range(8)]


def unshuffle_planes(planes: list[bytes], n_ids: int, kind: str) -> np.ndarray:
    out = np.zeros((4, n_ids), np.uint8)
    for i, plane in enumerate(planes):
        if kind == "byte":
            out[i] = np.frombuffer(plane, np.uint8)
        else:
            out[i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n_ids) << np.uint8(i % 8)
    return np.ascontiguousarray(out.T).view("<u4").ravel()


def open_uri(uri: str, mode: str):
    """A stream to or from a shared store; every scheme pyarrow knows, and plain paths."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


class ShardWriter:
    """Streams ids into one shard file; holds one block and the doc index in memory."""

    def __init__(self, uri: str, kind: str, block: int) -> None:
        import zstandard

        self.kind, self.block = kind, block
        self.out, self.place = open_uri(uri, "w"), 0
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.index: list[bytes] = []
        self.docs: list[tuple] = []
        self.total = 0
        self._put(MAGIC + bytes([PLANES[kind]]) + bytes(3))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id if doc_id is not None else 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.uint32)])
        at = 0
        while len(ids) - at >= self.block or rest and at < len(ids):
            part = ids[at : at + self.block]
            planes = [self.compress(p) for p in shuffle_planes(part, self.kind)]
            self.index.append(struct.pack(f"<QI{len(planes)}I", self.place, len(part), *map(len, planes)))
            self._put(b"".join(planes))
            at += len(part)
        self.waiting, self.held = [ids[at:]], len(ids) - at

    def close(self) -> int:
        self._flush(True)
        docs, doc_place = pd.DataFrame(self.docs, columns=["doc_id", "null", "n"]), self.place
        columns = (docs["doc_id"].to_numpy("<i8"), docs["null"].to_numpy("u1"), docs["n"].to_numpy("<u4"))
        self._put(self.compress(struct.pack("<Q", len(docs)) + b"".join(c.tobytes() for c in columns)))
        chunk_place = self.place
        self._put(b"".join(self.index))
        self._put(struct.pack("<QQ", doc_place, chunk_place) + MAGIC)
        self.out.close()
        return self.place


class ShardReader:
    """Reads a shard file by its indexes, a chunk at a time."""

    def __init__(self, uri: str) -> None:
        import zstandard

        self.expand = zstandard.ZstdDecompressor().decompress
        self.file = open_uri(uri, "r")
        size = self.file.size()
        head, tail = self._read(0, 8), self._read(size - 20, 20)
        if head[:4] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.planes = head[4]
        self.kind = next(k for k, n in PLANES.items() if n == self.planes)
        doc_place, chunk_place = struct.unpack("<QQ", tail[:16])
        entry = struct.Struct(f"<QI{self.planes}I")
        self.chunks = list(entry.iter_unpack(self._read(chunk_place, size - 20 - chunk_place)))
        docs = self.expand(self._read(doc_place, chunk_place - doc_place))
        (n,) = struct.unpack_from("<Q", docs)
        self.doc_ids = np.frombuffer(docs, "<i8", n, 8)
        self.null_ids = np.frombuffer(docs, "u1", n, 8 + 8 * n)
        self.sizes = np.frombuffer(docs, "<u4", n, 8 + 9 * n).astype(np.int64)

    def _read(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def chunk(self, number: int) -> np.ndarray:
        """The ids of one chunk, read alone."""
        place, n_ids, *sizes = self.chunks[number]
        data, planes, at = self._read(place, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.expand(data[at : at + size]))
            at += size
        return unshuffle_planes(planes, n_ids, self.kind)

    def documents(self) -> Iterator[tuple]:
        """(doc_id, ids) of each document in file order; memory: a chunk and a document."""
        held, number = np.zeros(0, np.uint32), 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.null_ids, self.sizes.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < size:
                parts.append(self.chunk(number))
                have += len(parts[-1])
                number += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc_id, held[:size]
            held = held[size:]


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, kind: str = "byte", block: int = BLOCK
) -> DataFrame:
    """Encode whole texts and write them as shard files in ascending doc_id order.

    A range partition is a shard, so shard numbers follow doc_id and no task sees
    more than its range. Returns the manifest, one row per file, to be written
    once. Null text: the end id alone. Null doc_id: first in order, kept as null.
    Rows that share a doc_id stay, ordered by the hash of their text. Columns but
    doc_id and text are left out.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, encoder, writer = TaskContext.get().partitionId(), token_ids(tokenizer), None
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tpl"
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encoder.ids_of(batch["text"].tolist()), strict=True):
                writer = writer or ShardWriter(path, kind, block)
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end]))
        if writer:
            size = writer.close()
            yield pd.DataFrame([(shard, path, len(writer.docs), writer.total, size)], columns=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return rows.mapInPandas(task, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` adds up the ids of the shards before; the window over shards has
    one row per file.
    """
    files = manifest.count()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"], strict=True):
                reader, out, at = ShardReader(path), [], int(before)
                for doc_id, ids in reader.documents():
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    before = F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids")
    shards = manifest.select("shard", "path", before.alias("before"))
    return shards.repartitionByRange(max(files, 1), "shard").mapInPandas(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_planes(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Write every document into shard files of the shared folder and read them back.

    An empty table gives no file and no row.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "token-planes")
    write_shards(docs, f"{folder}/shards", tokenizer, end_id, kind, block).write.parquet(f"{folder}/manifest")
    return read_shards(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
