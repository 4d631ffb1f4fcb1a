"""Vector codes: four codebooks of 256 entries, fitted by exact integer rounds over Hilbert-sorted blocks.

Each vector is cut into four parts. The parts are sorted by position and by their place on a Hilbert curve (a coarse grid between
the quantiles of a sample; the order steers cost, never a result) and packed into flat blocks of 256 with a box of least and
largest components, sums and a count. In each round a block's box gives every codebook entry a least and a largest distance;
entries that are farther at best than another is at worst are out. A block left with one entry hands over its sums as they are;
for others a small kernel of whole numbers compares the block's points with the entries left. Tasks add up sums and counts by
entry, so a round shuffles at most 1024 rows a task, and the codebooks (4 x 256 entries) are all that passes through the driver.
Range boundaries split equal curve places by row, so copies of one vector do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.vectors import integer_vectors, matrix
from sitefit.session import cut

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Points of a block, bits of a Hilbert key, rows of the sample that its grid is laid over.
BLOCK, KEY_BITS, SAMPLE = 256, 63, 4096
#: Totals by label up to this many are broadcast, more are joined over SALTS copies.
FEW_LABELS, SALTS = 50_000, 16

_KEYED = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("point", pa.binary())])
_BLOCKS = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("points", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_CODES = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def codes(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """Code and squared error of every vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go. The first codebook is made of the 256 smallest vec_ids
    (fewer, if there are fewer rows; rows of one id in the order of their components, rows without an id last). Repeated rows
    are all coded and all count. Vectors shorter than the longest, and lengths not divisible by 4, are filled up with zeros at
    the end. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(integer_vectors(vectors, scale, "label"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    part = -(-width // PARTS)
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).toArrow()
    books = matrix(start["v"], part * PARTS).reshape(len(start), PARTS, part).transpose(1, 0, 2).astype(np.int64)
    blocks = cut(_blocks(rows, part))
    for _ in range(ROUNDS if part else 0):
        books = _next(blocks, books)
    coded = _coded(blocks, books).groupBy("row").agg(
        F.sum(F.col("entry").cast("long") * F.expr(f"shiftleft(1L, 8 * ({PARTS - 1} - part))")).alias("code"), F.sum("error").alias("error"))
    out = cut(rows.select("row", "vec_id", "label").join(coded, "row"))
    listed = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return _with_label_error(out).select("vec_id", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error", "label_error", F.lit(listed).alias("codebooks_sha256"))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels (nulls are one label)."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if coded.select("label").distinct().count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return coded.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with `bits`-bit cell numbers (rows), for at most 63 bits in all.

    Skilling's transform ("Programming the Hilbert curve", 2004), on all points at a time.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _blocks(rows: DataFrame, part: int) -> DataFrame:
    """All parts as flat blocks in Hilbert order, a row each."""
    n = max(1, rows.count())
    seen = matrix(rows.select("v").sample(fraction=min(1.0, SAMPLE / n), seed=11).limit(2 * SAMPLE).toArrow()["v"], part * PARTS)
    low, high = (np.quantile(seen, q, axis=0) if len(seen) else np.zeros(part * PARTS) for q in (0.02, 0.98))
    used = min(part, KEY_BITS)  # a longer part is sorted by its first positions
    bits = max(1, KEY_BITS // max(used, 1)) if used else 0
    bits, step = min(bits, 8), np.maximum(high - low, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), part * PARTS)
            grid = np.clip((v - low) / step * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            for k in range(PARTS):
                own, cells = np.ascontiguousarray(v[:, k * part : (k + 1) * part]), grid[:, k * part : k * part + used]
                key = hilbert_keys(cells, bits) if used else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(key), batch.column(0), pa.array([p.tobytes() for p in own], pa.binary())], schema=_KEYED)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, number = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            points = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).reshape(len(of), part)
            edges = np.flatnonzero(np.diff(of)) + 1
            out = []
            for s, e in zip([0, *edges], [*edges, len(of)], strict=True):
                for a in range(s, e, BLOCK):
                    own = points[a : min(a + BLOCK, e)]
                    out.append((int(of[a]), number[a : min(a + BLOCK, e)].tobytes(), own.tobytes(), own.min(axis=0).tobytes(), own.max(axis=0).tobytes(), own.sum(axis=0, dtype=np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    spread = rows.select("row", "v").mapInArrow(keyed, _ddl(_KEYED)).repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return spread.mapInArrow(packed, _ddl(_BLOCKS))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point: the first nearest entry and its squared distance, in whole numbers.

    Doubles hold every step exactly while it stays below 2**53; larger numbers are compared as 64-bit integers.
    """
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if most * most * 4 * max(1, points.shape[1]) < 2**53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        far = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)
    else:
        far = np.stack([np.square(points.astype(np.int64) - e).sum(axis=1) for e in entries], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(points)), at].astype(np.int64)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks x entries: False where an entry is farther from the whole box than another is from its farthest corner."""
    low, high, e = low.astype(np.int64)[:, None, :], high.astype(np.int64)[:, None, :], entries[None, :, :]
    least = np.square(np.maximum(0, np.maximum(low - e, e - high))).sum(axis=2)
    most = np.square(np.maximum(np.abs(e - low), np.abs(high - e))).sum(axis=2)
    return least <= most.min(axis=1)[:, None]


def _each(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[int, dict, np.ndarray]]:
    """Every block with the numbers of the entries on its shortlist."""
    part = books.shape[2]
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            some = batch.slice(s, 64).to_pylist()
            low, high = (np.frombuffer(b"".join(x[name] for x in some), np.int32).reshape(len(some), part) for name in ("low", "high"))
            of = np.array([x["part"] for x in some])
            for k in np.unique(of):
                for at, keep in zip(np.flatnonzero(of == k), shortlists(low[of == k], high[of == k], books[k]), strict=True):
                    yield int(k), some[at], np.flatnonzero(keep)


def _next(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused entries stay."""
    part = books.shape[2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for k, block, kept in _each(batches, books):
            if len(kept) == 1:
                n[k, kept[0]] += len(block["rows"]) // 8
                sums[k, kept[0]] += np.frombuffer(block["sums"], np.int64)
                continue
            points = np.frombuffer(block["points"], np.int32).reshape(-1, part)
            at = kept[nearest(points, books[k][kept])[0]]
            n[k] += np.bincount(at, minlength=n.shape[1])
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums[k, at[order][heads]] += np.add.reduceat(points[order].astype(np.int64), heads, axis=0)
        of, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[of, entry]), pa.array(sums[of, entry].tolist(), pa.list_(pa.int64()))], schema=_SUMS)

    totals = blocks.mapInArrow(summed, _ddl(_SUMS)).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(part)]).alias("sums"))
    books = books.copy()
    for row in totals.collect():  # at most 4 x 256
        books[row["part"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """Entry and squared distance of every part."""
    part = books.shape[2]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block, kept in _each(batches, books):
            at, far = nearest(np.frombuffer(block["points"], np.int32).reshape(len(block["rows"]) // 8, part), books[k][kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(block["rows"], np.int64)), pa.array(np.full(len(at), k, np.int32)), pa.array(kept[at], pa.int32()), pa.array(far)], schema=_CODES)

    return blocks.mapInArrow(assigned, _ddl(_CODES))
