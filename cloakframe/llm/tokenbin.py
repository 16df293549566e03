"""Token ids as length-delimited binary records with a separate offset index.

A shard is two files in a folder that all executors share. ``NNNNNNNN.records`` holds frames: the payload's length
(uint64), the masked crc32 of those eight bytes (uint32), the payload, the payload's masked crc32 (uint32), all little
endian. A payload is doc_id (int64), a presence byte and the ids, each of ``width`` bytes. ``NNNNNNNN.index`` holds each
frame's offset (uint64), so a reader can fetch frames in any order. Shards hold ascending ranges of doc_id.

A task writes under a name of its own attempt and renames when the file is whole; a repeated task leaves the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import occupies
from .fastbpe import encoder

#: Layouts of a record's head (length, checksum) and tail (checksum) and of what precedes the ids.
HEAD, TAIL, ID = "<QI", "<I", "<q?"
HEAD_SIZE, TAIL_SIZE, ID_SIZE = (struct.calcsize(x) for x in (HEAD, TAIL, ID))
#: The rotation and the constant of the masked checksum.
_MASK_DELTA = 0xA282EAD8
#: Bytes of frames that are written or read at once.
BLOCK = 8 << 20
#: Bytes of texts that go to one shard on average, at most.
SHARD_BYTES = 512 << 20


class CorruptRecord(ValueError):
    """A frame's lengths or checksums don't hold."""


def masked_crc(data: bytes) -> int:
    """crc32, rotated right by 15 bits and shifted, so that a checksum of data with checksums stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked_crc(length)) + payload + struct.pack(TAIL, masked_crc(payload))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one begins."""
    if len(data) < at + HEAD_SIZE:
        raise CorruptRecord("a record ends early")
    length, check = struct.unpack_from(HEAD, data, at)
    if check != masked_crc(data[at : at + 8]):
        raise CorruptRecord("a record's length is damaged")
    begin, end = at + HEAD_SIZE, at + HEAD_SIZE + length
    if len(data) < end + TAIL_SIZE:
        raise CorruptRecord("a record ends early")
    payload = data[begin:end]
    if struct.unpack_from(TAIL, data, end)[0] != masked_crc(payload):
        raise CorruptRecord("a record's payload is damaged")
    return payload, end + TAIL_SIZE


def _open(folder: str):
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, root


def _writer(folder: str, path: str, end_id: int | None, width: int):
    def run(batches):
        occupies("tokenbin")
        fs, root = _open(folder)
        shard = TaskContext.get().partitionId()
        own = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
        fs.create_dir(root, recursive=True)
        enc, offsets, at, tokens, rows = encoder(path, "byte"), [], 0, 0, 0
        if max(enc.size - 1, end_id or 0) >= 1 << 8 * width:
            raise ValueError("the vocabulary's ids don't fit the width")
        kind, end = f"<u{width}", b"" if end_id is None else end_id.to_bytes(width, "little")
        with fs.open_output_stream(f"{own}.records") as out:
            block: list[bytes] = []
            held = 0
            for batch in batches:
                ids_of = enc.encode_all(batch.column("text").to_pylist())
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                    record = frame(struct.pack(ID, doc_id or 0, doc_id is not None) + ids.astype(kind).tobytes() + end)
                    offsets.append(at)
                    at, tokens, rows, held = at + len(record), tokens + len(ids) + (end_id is not None), rows + 1, held + len(record)
                    block.append(record)
                    if held >= BLOCK:
                        out.write(b"".join(block))
                        block, held = [], 0
            out.write(b"".join(block))
        with fs.open_output_stream(f"{own}.index") as out:
            out.write(np.array(offsets, dtype="<u8").tobytes())
        for name in ("records", "index"):
            fs.move(f"{own}.{name}", f"{root}/{shard:08d}.{name}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": rows, "n_tokens": tokens, "n_bytes": at}])

    return run


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, width: int = 2, parts: int | None = None) -> list[dict]:
    """Encode ``text`` and write the records in ascending doc_id order, null ids first; returns one entry a shard.

    Null texts are empty; rows with the same doc_id lie in the order of their texts, of a hash of them first, so that many
    rows of one id, or without one, are spread. ``width`` is 2 for vocabularies of up to 65,536 ids, else 4; a vocabulary
    that doesn't fit is an error. There are as many shards as ``SHARD_BYTES`` of texts ask for, ``spark.sql.shuffle.partitions`` at
    least, or ``parts``. Each entry: shard, n_docs, n_tokens, n_bytes. No rows give no shards; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    n = parts
    if n is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
        n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    done = dealt.mapInArrow(_writer(folder, tokenizer_path, end_id, width), "shard long, n_docs long, n_tokens long, n_bytes long").collect()
    return sorted((r.asDict() for r in done if r["n_docs"]), key=lambda r: r["shard"])


def read_payload(folder: str, shard: int, row: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index, for shuffled reads."""
    fs, root = _open(folder)
    with fs.open_input_file(f"{root}/{shard:08d}.index") as f:
        f.seek(8 * row)
        at = int.from_bytes(f.read(8), "little")
    with fs.open_input_file(f"{root}/{shard:08d}.records") as f:
        f.seek(at)
        head = f.read(HEAD_SIZE)
        payload, _ = unframe(head + f.read(struct.unpack(HEAD, head)[0] + TAIL_SIZE))
    return _parse(payload, width)


def _parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc_id, there = struct.unpack_from(ID, payload)
    return doc_id if there else None, np.frombuffer(payload, dtype=f"<u{width}", offset=ID_SIZE)


def _reader(folder: str, width: int, with_ids: bool):
    def run(batches):
        fs, root = _open(folder)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{shard:08d}.index") as f:
                    offsets = np.frombuffer(f.read(), dtype="<u8")
                with fs.open_input_file(f"{root}/{shard:08d}.records") as f:
                    ends, row = np.append(offsets[1:], np.uint64(f.size())), 0
                    while row < len(offsets):
                        till = max(row + 1, int(np.searchsorted(ends, offsets[row] + np.uint64(BLOCK))))
                        f.seek(int(offsets[row]))
                        data, at, out = f.read(int(ends[till - 1] - offsets[row])), 0, []
                        for _ in range(row, till):
                            payload, at = unframe(data, at)
                            doc_id, ids = _parse(payload, width)
                            ids = ids.astype("<u4")
                            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                            start += len(ids)
                        if at != len(data):
                            raise CorruptRecord("the index and the records differ")
                        row = till
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    return run


def read_token_records(spark: SparkSession, folder: str, shards: list[dict], width: int = 2, with_ids: bool = False) -> DataFrame:
    """Read shards back and check them: doc_id, start (ids of all records before it), n_tokens, ids_crc32 and, if wanted, ids.

    A task reads one shard; ``shards`` are entries that the writer returned. No shards give no rows.
    """
    first, rows = 0, []
    for s in shards:
        rows.append((s["shard"], first))
        first += s["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    listed = spark.createDataFrame(rows, "shard long, first long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_reader(folder, width, with_ids), schema)
