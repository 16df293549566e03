"""Best-fit packing of token sequences with a bounded number of open bins.

Online best-fit: a piece goes to the open bin with the least free space that holds it. Open bins are kept by free space,
with a bitset of the occupied free spaces, so the best bin is one shift and one bit scan away. When a new bin is needed
and ``OPEN`` bins are open, the fullest closes first. Each task packs what it reads; bins that are still open at its end
are packed again as items, by ever fewer tasks, until the last one: only its open bins stay partly filled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, durable, occupies
from .fastbpe import encoder

#: Open bins of a packer.
OPEN = 256
#: Texts that a Python worker gets at once.
BATCH = 500
#: Packers whose open bins the next round's packer takes.
FAN_IN = 32


class BestFit:
    """Online best-fit into bins of ``capacity``; ``add`` returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN):
        self.capacity, self.most, self.made, self.open = capacity, open_bins, 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0  # bit f: an open bin has f free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def add(self, size: int) -> tuple[int, int]:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            free, number = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def still_open(self) -> list[tuple[int, int]]:
        """(bin number, tokens in it) of the open bins."""
        return [(n, self.capacity - f) for f, bins in self.by_free.items() for n in bins]


def _pack(path: str, capacity: int, end_id: int, open_bins: int, with_ids: bool):
    def run(batches):
        occupies("packing")
        part, fit, enc = TaskContext.get().partitionId(), BestFit(capacity, open_bins), encoder(path, "word")
        for batch in batches:
            out = []
            ids_of = enc.encode_all(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    number, offset = fit.add(len(cut))
                    out.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes()), (part << 32) + number, offset, cut.astype("<i4") if with_ids else None))
            yield _batch(out)

        yield _batch([(None, -1, None, fill, None, (part << 32) + number, None, None) for number, fill in fit.still_open()])

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]


def _batch(rows):
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, _KINDS, strict=True)], [f.split()[0] for f in _PIECES.split(", ")])


def _repack(capacity: int, open_bins: int, level: int):
    """Open bins as items: (bin, fill, group) -> (bin, sequence_id, base, fill of the new bin if still open)."""

    def run(batches):
        fits: dict[int, BestFit] = {}
        for batch in batches:
            out = []
            for number, fill, group in zip(*(batch.column(c).to_pylist() for c in ("bin", "fill", "group")), strict=True):
                new, base = fits.setdefault(group, BestFit(capacity, open_bins)).add(fill)
                out.append((number, ((level << 56) | (group << 32)) + new, base, None))
            yield batch_of(out)
        yield batch_of([(None, ((level << 56) | (g << 32)) + n, None, fill) for g, fit in fits.items() for n, fill in fit.still_open()])

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in columns], ["bin", "sequence_id", "base", "fill"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack all rows of ``docs`` (doc_id, text); one row for each piece of a document.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids. A null text is empty and
    has its end id alone; only documents of more than ``capacity`` ids are cut; repeated rows are packed each for
    itself; null doc_ids stay. An empty table gives no pieces. Packed pieces are written to the shared folder once,
    so texts are tokenized once and sequences stay the same when executors are lost.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    with batches_of(docs.sparkSession, BATCH):
        packed = durable(rows.mapInArrow(_pack(tokenizer_path, capacity, end_id, open_bins, with_ids), _PIECES), "packed")
    left = packed.where("piece = -1").select(F.col("sequence_id").alias("bin"), F.col("length").alias("fill"))
    groups, level, moves = rows.rdd.getNumPartitions(), 0, None
    left = left.withColumn("part", F.shiftright("bin", 32))
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN_IN)
        # Large fills first makes a round's fit tighter; a group's rows lie in one partition, side by side.
        dealt = left.select("bin", "fill", F.floor(F.col("part") / FAN_IN).alias("group")).repartition(min(groups, 4096), "group").sortWithinPartitions("group", F.desc("fill"), "bin")
        done = durable(dealt.mapInArrow(_repack(capacity, open_bins, level), "bin long, sequence_id long, base long, fill long"), "repacked")
        step = done.where("bin is not null").select("bin", "sequence_id", "base")
        if moves is None:
            moves = step
        else:
            again = step.select(F.col("bin").alias("sequence_id"), F.col("sequence_id").alias("next"), F.col("base").alias("more"))
            moves = moves.join(again, "sequence_id", "left").select("bin", F.coalesce("next", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        left = done.where("bin is null").select(F.col("sequence_id").alias("bin"), "fill", F.shiftright("sequence_id", 32).bitwiseAND((1 << 24) - 1).alias("part"))
    pieces = packed.where("piece >= 0")
    if moves is not None:
        moves = moves.select(F.col("bin").alias("sequence_id"), F.col("sequence_id").alias("next"), "base")
        pieces = pieces.join(moves, "sequence_id", "left").withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0))).withColumn("sequence_id", F.coalesce("next", "sequence_id"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
