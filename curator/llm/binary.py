"""Token ids in bit-packed binary shards with random access.

A shard holds the documents of one range of doc_ids, in order:

    magic (8 bytes)
    blocks: `block` ids each (the last may hold fewer), every id in `width` bits, low bits first, from a whole byte
    footer: doc_ids (int64), ids per document (int64), block offsets (int64, one more than blocks)
    trailer: documents, ids, width, block, footer offset (int64 each), magic

All numbers are little-endian. `width` is the least number of bits for the vocabulary. Any range of ids is read from
the blocks that hold it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curator.llm.common import in_order, materialize, narrow, partitions
from curator.llm.tokens import default_path, encoder
from curator.runtime import scratch_path

MAGIC = b"PACKIDS1"
BLOCK = 1 << 16
TRAILER = 5 * 8 + len(MAGIC)
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id


def width_for(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """`width` bits per id, low bits first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : width // 8] = raw[: n * width // 8].reshape(n, width // 8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(raw, bitorder="little")[: n * width].reshape(n, width)
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Appends documents to one shard; holds one open block and the footer, never the shard."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.ids, self.sizes, self.offsets, self.rest, self.total = [], [], [len(MAGIC)], bytearray(), 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids`: little-endian unsigned 32-bit integers."""
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.rest += ids
        step = 4 * self.block
        while len(self.rest) >= step:
            self._write(bytes(self.rest[:step]))
            del self.rest[:step]

    def _write(self, ids: bytes) -> None:
        data = pack(np.frombuffer(ids, "<u4"), self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.rest:
            self._write(bytes(self.rest))
        for part in (self.ids, self.sizes, self.offsets, [len(self.ids), self.total, self.width, self.block, self.offsets[-1]]):
            self.out.write(np.array(part, "<i8").tobytes())
        self.out.write(MAGIC)
        self.out.close()


class ShardReader:
    """Random access to one shard; only the footer and one block are held."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = self._at(size - TRAILER, TRAILER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, self.total, self.width, self.block, at = np.frombuffer(tail[: -len(MAGIC)], "<i8").tolist()
        footer = np.frombuffer(self._at(at, size - TRAILER - at), "<i8")
        self.doc_ids, self.sizes, self.offsets = footer[:n], footer[n : 2 * n], footer[2 * n :]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held = (-1, np.zeros(0, "<u4"))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            n = min(self.block, self.total - k * self.block)
            self.held = (k, unpack(self._at(a, b - a), self.width, n))
        return self.held[1]

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start .. start + n of the shard, block by block."""
        while n > 0:
            k, skip = divmod(start, self.block)
            part = self._block(k)[skip : skip + n]
            yield part
            start, n = start + len(part), n - len(part)

    def document(self, i: int) -> np.ndarray:
        parts = [*self.parts(int(self.starts[i]), int(self.sizes[i]))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _files(root: str):
    """The file system of a folder by its URI or path, for use inside tasks."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(root)
    return where, path


def write_ids(
    docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
) -> DataFrame:
    """Encode every whole text, append `end_id`, and write shards under `root` in ascending doc_id order.

    `root` is a folder that all executors share. Returns the manifest, one row per shard: bucket, path, n_docs, n_ids
    and start (ids in all earlier shards). One shuffle places the documents into ranges of doc_id; a task sorts its
    ranges and streams them into files. A task that runs again writes files of other names, and the manifest, which
    Spark commits, names only those of the attempt that counts. Null and empty texts are documents of the end id
    alone; null ids come first; repeated ids follow each other. An empty table has no shard.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    rows, _ = in_order(narrow(docs, id_col, text_col), buckets or 2 * partitions(spark))
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        where, folder = _files(root)
        where.create_dir(folder, recursive=True)
        width, done, now, shard, name = width_for(max(enc.vocab_size, end_id + 1)), [], None, None, ""

        def finish():
            shard.close()
            done.append((now, name, len(shard.ids), shard.total))

        for batch in batches:
            for bucket, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    if shard is not None:
                        finish()
                    now, name = bucket, f"ids-{bucket:07d}-{uuid.uuid4().hex}.bin"
                    shard = ShardWriter(where.open_output_stream(f"{folder}/{name}"), width)
                shard.add(doc_id, enc.encode(text) + end)
        if shard is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bucket", "name", "n_docs", "n_ids"])

    placed = rows.select("bucket", "doc_id", "text").repartition(partitions(spark), "bucket")
    ordered = placed.sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))
    written = materialize(ordered.mapInArrow(shards, "bucket int, name string, n_docs bigint, n_ids bigint"), "manifest")
    # One row per shard: the number of shards follows the number of partitions, not the rows.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return written.select(
        "bucket", F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("path"), "n_docs", "n_ids",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards that `manifest` names."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, name = _files(path)
                with where.open_input_file(name) as source:
                    shard = ShardReader(source)
                    sums = np.zeros(len(shard.sizes), np.int64)
                    for i, (at, n) in enumerate(zip(shard.starts.tolist(), shard.sizes.tolist())):
                        crc = 0
                        for part in shard.parts(at, n):
                            crc = zlib.crc32(part, crc)
                        sums[i] = crc
                ids = pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID)
                columns = [ids, pa.array(shard.starts + start), pa.array(shard.sizes), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents as shards in the shared folder and read them back."""
    return read_ids(write_ids(docs, scratch_path(docs.sparkSession, "ids"), tokenizer, end_id))
