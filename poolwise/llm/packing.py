"""Packing along a space-filling curve: similar documents share sequences.

A document's tokens, hashed to a vector of damped counts of length one, are projected to ``DIMS`` numbers
by a seeded matrix and quantised; the place of that cell on a Hilbert curve is its key.  Documents are dealt
by ranges of (key, id).  Along the curve, a document's full stretches of ``LENGTH`` tokens become the next
sequences, and what is left of it goes to the open sequence, which is cut where it is full; only the last open
sequence of a range is padded.  So ids of full and of filled sequences both follow the curve.  Ranges are sized
by leftover tokens, so padding is below one part in ``PER_RANGE / LENGTH``; keys that many documents share are
split by id, and no task holds more than its range.

The texts are tokenized once, into a staged table that holds the leftover ids and the checksums of full
stretches; the shuffle by key moves only these.  Sequence ids come from the partition and a counter, so a
repeated task gives the same ones.

Defined cases: a null text is empty and has the closing id alone; repeated rows are packed once each; a null
id is packed like any other; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm.staging import ship, stage
from poolwise.llm.tokens import VOCABULARY, encoder, id_type

LENGTH = 1024
DIMS, BITS, HASHED = 4, 12, 1024
SEED = 20250101
#: Tokens that a range of the curve should hold.
PER_RANGE = 1 << 20


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells (n, dims) of ``bits`` bits a side, after Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(seed: int = SEED) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((HASHED, DIMS))


def curve_keys(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    vectors = np.stack([np.sqrt(np.bincount(i % HASHED, minlength=HASHED)) for i in ids])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    # entries of a projection of a unit vector are about normal: three deviations fill the grid
    cells = np.clip(((vectors @ matrix + 3) / 6 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def _tokenized(vocabulary: str, length: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, matrix = encoder(vocabulary), projection(seed)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                ids = [np.append(coder.ids(t.as_py() or ""), np.uint32(0)).astype("<u4") for t in part.column(1)]
                heads = [[zlib.crc32(i[k : k + length].tobytes()) for k in range(0, len(i) - length + 1, length)] for i in ids]
                tails = [i[len(i) // length * length :].astype(kind).tobytes() for i in ids]
                out = [part.column(0), pa.array(curve_keys(ids, matrix)), pa.array([len(i) for i in ids], pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["id", "key", "tokens", "heads", "tail"])

    return run


_PIECE = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key")])


_ROWS_AT_ONCE = 20_000


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECE)


def _packed(length: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the open sequence, the next free id, and the place in the open one
        sequence, free, offset, rows = TaskContext.get().partitionId() << 32, (TaskContext.get().partitionId() << 32) + 1, 0, []
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                for doc, key, tokens, heads, tail in zip(*(part.column(n).to_pylist() for n in ("id", "key", "tokens", "heads", "tail")), strict=True):
                    for nth, crc in enumerate(heads):
                        rows.append((doc, nth * length, length, crc, tokens, free, 0, key))
                        free += 1
                    ids = np.frombuffer(tail, kind).astype("<u4")
                    start, at_id = len(heads) * length, 0
                    while at_id < len(ids):
                        take = min(length - offset, len(ids) - at_id)
                        rows.append((doc, start + at_id, take, zlib.crc32(ids[at_id : at_id + take].tobytes()), tokens, sequence, offset, key))
                        at_id, offset = at_id + take, offset + take
                        if offset == length:
                            sequence, free, offset = free, free + 1, 0
                if len(rows) >= _ROWS_AT_ONCE:
                    yield _pieces(rows)
                    rows = []
        yield _pieces(rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``curve_key``."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = stage(source.mapInArrow(_tokenized(vocabulary, length, seed, id_type(vocabulary)), "id long, key long, tokens long, heads array<long>, tail binary"), "tokens")
    left = table.agg(F.sum(F.col("tokens") % length)).first()[0] or 0
    ranges = max(1, -(-left // PER_RANGE))
    dealt = table.repartitionByRange(ranges, "key", "id", "tokens").sortWithinPartitions("key", "id", "tokens", "tail", "heads")
    pieces = dealt.mapInArrow(_packed(length, id_type(vocabulary)), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")
    return pieces.withColumnRenamed("id", id_col)


def op6_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
