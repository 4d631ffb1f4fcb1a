"""What the operators share: reading the tables, words as bytes, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII to lower case, for `bytes.translate`.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of a filter over ids (a prime, 2 MB).
BITS = 16_777_213
#: Documents that one Python step takes at a time.
STEP_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The ids and texts of `documents`; nothing else is read."""
    return table(spark, folder, "documents").select("doc_id", "text")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes that separate words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; bounds a worker's memory, changes no result.
CHUNK_BYTES = 1 << 21

_BYTE = np.random.default_rng(20_241).integers(1 << 62, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, factor: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """A finishing step that spreads every bit of 64-bit values over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(27))


class WordHashes:
    """64-bit hashes of the words of texts, whole arrays at a time.

    A word's hash is a polynomial of its bytes (each replaced by a fixed random odd number) modulo 2**64, taken as a
    difference of running sums and shifted back to the word's own start, then mixed. It depends on the word alone.
    """

    def __init__(self, lower: bool = True) -> None:
        self.lower = lower
        self.up, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, text: bytes | None) -> np.ndarray:
        return self.of_all([text])[0]

    def of_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The word hashes of each text, in the order of its words."""
        out: list[np.ndarray] = []
        group, held = [], 0
        for text in texts:
            if group and held + len(text or b"") > CHUNK_BYTES:
                out += self._group(group)
                group, held = [], 0
            group.append(text or b"")
            held += len(group[-1])
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(text) + 1 for text in texts])
        flat = b"\n".join(texts) + b"\n"
        if self.lower:
            flat = flat.translate(LOWER)
        pieces, at = [], 0
        while at < len(flat):
            stop = min(at + 2 * CHUNK_BYTES, len(flat))
            while stop < len(flat) and not BLANK[flat[stop - 1]]:
                stop += 1
            starts, found = self._hashes(np.frombuffer(flat, np.uint8, stop - at, at))
            pieces.append((starts + at, found))
            at = stop
        starts, found = (np.concatenate(p) for p in zip(*pieces, strict=True))
        return np.split(found, np.searchsorted(starts, ends[:-1]))

    def _hashes(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(flat)
        if len(self.up) < n + 1:
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]))
            self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[flat], [True]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[flat] * self.up[:n], out=sums[1:])
        return starts, mixed((sums[ends] - sums[starts]) * self.back[starts])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row however often they are used later."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words between the blanks 0x20 and 0x09-0x0D (which are what bytes.split() splits at)."""
    return (text or b"").translate(LOWER).split()


def steps(batches: Iterable[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bit per remainder of the ids modulo BITS: a fixed-size filter without false negatives."""
    bit = F.pmod("id", F.lit(BITS))
    found = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("bits"))
    words = np.zeros(BITS // 32 + 1, np.uint32)
    for row in found.toArrow().to_batches():
        words[row.column(0).to_numpy()] = row.column(1).to_numpy().astype(np.uint32)
    return words


def in_bitmap(doc_id: int | None, words: np.ndarray) -> bool:
    return doc_id is not None and bool(words[doc_id % BITS >> 5] >> (doc_id % BITS & 31) & 1)


def map_texts(docs: DataFrame, step: Callable[[], Callable[[list, list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs `step()` once a task and what it returns on (ids, texts as UTF-8 bytes or None) a few hundred rows at a time.

    Only the two columns are sent to Python. The function returned gives a dict of column -> values in the order of `schema`.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = step()
        for part in steps(batches):
            out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)

    return narrow.mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a plain DDL string whose types are in _KINDS."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.strip().split(" ", 1) for part in schema.split(","))])
