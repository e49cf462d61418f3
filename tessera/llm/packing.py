"""Best-fit packing of tokenised documents, with lower bounds that certify each partition.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt by hash to groups of
about ``per_partition`` pieces, and each partition packs its own by best-fit decreasing.  Dual
feasible functions bound from below the bins that any packing of a partition needs; a partition
that meets its bound is certified and keeps its bins, all but those far from full.  A partition
with a gap gives up every bin that leaves room.  What is given up is dealt anew among fewer
partitions, so documents change places between them, and best-fit decreasing runs again, until
one small partition or ``rounds`` rounds remain; the last closes everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_parts, tokenizer_path, written
from .transducer import machine

SLICE_CHARS = 1_000_000
#: A sequence's id is its turn, group and bin in fields of their own; no group comes near this many bins.
BIN_BITS, TURN_SHIFT = 22, 58
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """The pieces of each document: its token ids and ``end_id``, cut only where longer than ``capacity``.

    A null or empty text is one piece of one id.  Repeated rows give their pieces each.
    """
    path = tokenizer or tokenizer_path()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = machine(path)
        for batch in batches:
            for own, texts in text_parts(batch, 1, SLICE_CHARS):
                yield _cut(encoder, own.column(0), texts, capacity, end_id)

    return given.mapInArrow(run, PIECES.format(id=kind))


def _cut(encoder, ids: pa.Array, texts: list, capacity: int, end_id: int) -> pa.RecordBatch:
    tokens, ends = encoder.encode(texts)
    tail = np.array([end_id], "<u4").tobytes()
    row, piece, start, length, crc = [], [], [], [], []
    begin = 0
    for i, end in enumerate(ends.tolist()):
        data = tokens[begin:end].astype("<u4").tobytes() + tail
        total, begin = end - begin + 1, end
        for k, at in enumerate(range(0, total, capacity)):
            size = min(capacity, total - at)
            row.append(i)
            piece.append(k)
            start.append(at)
            length.append(size)
            crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of a family of dual feasible functions on the bins that ``sizes`` need.

    Used are the identity; for each k up to 20 the rounding function that sends x to
    floor((k+1)x/C)/k (x itself where (k+1)x/C is whole); and for each threshold e up to half the
    capacity the function that lifts sizes above C-e to C and drops those below e.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    weight, below = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    large = below[capacity] - below[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes in decreasing order: the bin of each and its offset there."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for i, size in enumerate(sizes.tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            own, room, opened = opened, capacity, opened + 1
        bins[i], offsets[i] = own, capacity - room
        if room > size:
            by_room.setdefault(room - size, []).append(own)
            rooms |= 1 << (room - size)
    return bins, offsets


def _packer(columns: list[str], capacity: int, open_share: float, turn: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = int(bins.max()) + 1
        room = capacity - np.bincount(bins, sizes, used).astype(np.int64)
        certified = used == lower_bound(sizes, capacity)
        gives = room >= open_share * capacity if certified else room > 0
        if used >> BIN_BITS:
            raise OverflowError("too many sequences in one group")
        first = turn << TURN_SHIFT | rows["tessera_group"][0].as_py() << BIN_BITS
        return (
            rows.select(columns)
            .append_column("sequence_id", pa.array(first + bins, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
            .append_column("certified", pa.array(np.full(len(sizes), certified)))
            .append_column("closed", pa.array(last | ~gives[bins]))
        )

    return run


def pack(items: DataFrame, capacity: int = 4096, per_partition: int = 2048, rounds: int = 4, open_share: float = 1 / 16) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``certified`` to pieces (doc_id, piece, start, length, ids_crc32).

    Every row is placed once, repeated rows and null ids included; ``length`` must lie in
    1..capacity.  ``items`` should be a written table: groups are dealt by its ids and row places.
    ``certified`` says that the partition that closed the row's sequence met its lower bound.
    ``open_share``: certified partitions give up bins with at least this share free.
    An empty input gives an empty result.
    """
    spark = items.sparkSession
    columns = items.columns
    schema = items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"), F.lit(True).alias("closed")).schema
    left, done = items, []
    for turn in range(rounds):
        n = left.count()
        if n == 0:
            break
        groups = -(-n // per_partition)
        last = groups == 1 or turn == rounds - 1

        # rows of one id, null ids too, are told apart by their place in the written table, so no key is hot
        key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).cast("long")
        packed = written(left.select(*columns, key.alias("tessera_group")).groupBy("tessera_group").applyInArrow(_packer(columns, capacity, open_share, turn, last), schema), "packed")
        done.append(packed.where("closed").drop("closed"))
        if last:
            break
        left = packed.where("not closed").select(*columns)
    if not done:
        return spark.createDataFrame([], schema).drop("closed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(written(pieces(docs), "pieces"))
