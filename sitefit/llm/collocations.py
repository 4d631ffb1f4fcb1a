"""Phrase collocations from a prefix-free parse of the texts.

Every text is cut where four consecutive words hash to a trigger; a chunk ends with the trigger words and the next one begins with
them. What a cut depends on is its own words alone, so copied passages fall into the same chunks wherever they stand: the distinct
chunks (by language) are the dictionary, their frequencies sum up the parse. Phrases of up to five words are then counted inside
distinct chunks, weighted by frequency. A phrase belongs to the chunk in which its first word stands before the closing trigger
words; these four words are all that a phrase may still need, so each occurrence is counted exactly once.

Counting goes by length. A phrase can only reach the least count if both its parts of one word less do, so a pass counts only
those; which ones do is told by a bitmap of fixed size (a false hit costs work, no result). A pass sends 64-bit hashes with counts,
packed by shard; the last pass counts the survivors once more by their words, packed in the same way. No pass knows a cap on phrases, texts or chunks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.llm.base import BITS, LOWER, id_bitmap, mixed
from sitefit.session import cut, scratch_folder

#: Words of a trigger (one less than the longest phrase), and one in how many word places is one.
TRIGGER, ONE_IN = 4, 32
#: Bytes parsed at a time, hashes held by a task before they are summed, hashes of a shard; steer memory, change no result.
CHUNK_BYTES, HELD, SHARD = 1 << 21, 1 << 21, 2_000_000
#: Tables by language of at most so many rows are broadcast.
FEW_LANGS = 10_000

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_GAP[[0x20, 0x09]] = True
_GAP |= _BREAK
_LETTER = np.random.default_rng(71_993).integers(1 << 62, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_UP = 0xD1342543DE82EF95
_NEXT, _JOIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)

_PARSE = pa.schema([("lang", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary()), ("words", pa.int64())])
_PACKED = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("size", pa.int32()), ("f", pa.int64())])
_LISTS = pa.schema([("shard", pa.int32()), *[(f.name, pa.list_(f.type)) for f in _PHRASES]])


class Parser:
    """Words of bytes: where they start and end, their piece's number, their hashes."""

    def __init__(self) -> None:
        self.up, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(flat, np.uint8)
        n = len(raw)
        if len(self.up) < n + 1:
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _UP, np.uint64)]))
            self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_UP, -1, 1 << 64), np.uint64)]))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[raw], [True]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw] * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.back[starts])
        return starts, ends, np.cumsum(_BREAK[raw], dtype=np.int32)[starts], hashes


def grown(hashes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of `size` words from those of one word less; as many as there are places left."""
    m = max(0, len(words) - size + 1)
    return mixed(hashes[:m] * _NEXT + words[size - 1 : size - 1 + m] * _JOIN)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK_BYTES bytes (at least one row)."""
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_BYTES, "right")) - 1)
        yield at, stop
        at = stop


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, last (the text ends with it), chunk, words (whose phrases it counts), n (frequency)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            langs, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in _groups(np.array([len(t) + 1 for t in texts])):
                flat = (b"\n".join(texts[a:b]) + b"\n").translate(LOWER)
                starts, ends, _, words = parser.of(flat)
                if not len(words):
                    continue
                stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[a:b]]))  # of each text's words
                begins = np.concatenate([[0], stops[:-1]])
                window = words.copy()
                for size in range(2, TRIGGER + 1):
                    window = grown(window, words, size)
                place = np.flatnonzero(window % np.uint64(ONE_IN) == 0)
                text = np.searchsorted(stops, place, "right")
                place = place[(place > begins[text]) & (place + TRIGGER <= stops[text])]
                heads = np.unique(np.concatenate([begins[begins < stops], place]))
                text = np.searchsorted(stops, heads, "right")
                last = np.append(text[1:] != text[:-1], True)
                tails = np.where(last, stops[text], np.append(heads[1:], 0) + TRIGGER)
                found = [flat[s:e] for s, e in zip(starts[heads].tolist(), ends[tails - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(text + a)), pa.array(last), pa.array(found, pa.binary()), pa.array(tails - heads - np.where(last, 0, TRIGGER))], schema=_PARSE)

    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(chunks, "lang string, last boolean, chunk binary, words long").groupBy("lang", "last", "chunk", "words").agg(F.count("*").alias("n"))


class _Phrases:
    """Phrases of chunks: hashes by length, which places count, weights."""

    def __init__(self) -> None:
        self.parser, self.langs = Parser(), {}

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        return self.langs[name]

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """For some chunks at a time: text, starts, ends, chunk of each word, piece of each word, word hashes, owned places, weights."""
        chunks, counted, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        names = batch.column(0).dictionary_encode()
        seed = np.array([self.lang(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
        sizes = np.array([len(c) + 1 for c in chunks])
        for a, b in _groups(sizes):
            flat = b"\n".join(chunks[a:b]) + b"\n"
            starts, ends, piece, words = self.parser.of(flat)
            stops = np.searchsorted(starts, np.cumsum(sizes[a:b]))
            of = np.repeat(np.arange(a, b), np.diff(stops, prepend=0))
            owned = np.arange(len(words)) - np.concatenate([[0], stops[:-1]])[of - a] < counted[of]
            yield flat, starts, ends, of, piece, mixed(words ^ seed[of]), owned, n[of]


def _hits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes.view(np.int64) % BITS
    return bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) == 1


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, c = h[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[heads], np.add.reduceat(c, heads) if len(h) else c


def _frequent(dictionary: DataFrame, size: int, least: int, bits: np.ndarray | None, shards: int) -> DataFrame:
    """Hashes (`id`) of the phrases of `size` words that occur at least `least` times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, hashes, counts, held = _Phrases(), [], [], 0

        def packed() -> pa.RecordBatch:
            h, c = _summed(hashes, counts)
            shard = h % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            out = [(k, h[own].tobytes(), c[own].tobytes()) for k in range(shards) if len(own := order[edges[k] : edges[k + 1]])]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            for _, _, _, _, piece, words, owned, n in phrases.of(batch):
                own = words
                for m in range(2, size):
                    own = grown(own, words, m)
                at = np.flatnonzero(owned)
                if size > 1:
                    at = at[at + size <= len(words)]
                    at = at[piece[at] == piece[at + size - 1]]
                    seen = _hits(own, bits)
                    at = at[seen[at] & seen[at + 1]]
                    own = mixed(own[at] * _NEXT + words[at + size - 1] * _JOIN)
                else:
                    own = own[at]
                hashes.append(own)
                counts.append(n[at])
                held += len(own)
                if held > HELD:
                    h, c = _summed(hashes, counts)
                    hashes, counts, held = [h], [c], len(h)
                    if held > HELD // 2:
                        yield packed()
                        hashes, counts, held = [], [], 0
        if held:
            yield packed()

    def merged(table: pa.Table) -> pa.Table:
        h, c = _summed([np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        return pa.table({"id": h[c >= least].view(np.int64)})

    return dictionary.mapInArrow(counted, "shard int, hashes binary, counts binary").groupBy("shard").applyInArrow(merged, "id long")


def _phrases(dictionary: DataFrame, bits: list[np.ndarray], least: int, shards: int) -> DataFrame:
    """Phrases whose hashes the bitmaps know and that, told apart by their words, occur at least `least` times: lang, phrase, size, f."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, held = _Phrases(), {}

        def out() -> pa.RecordBatch:
            """What is held, a row of lists by shard."""
            shard = np.array([h % shards for _, h in held])
            order = np.argsort(shard, kind="stable")
            heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
            offsets = pa.array(np.append(heads, len(order)), pa.int32())
            flat = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held.values(), strict=True), _PHRASES, strict=True)], schema=_PHRASES).take(pa.array(order)).combine_chunks()
            lists = [pa.ListArray.from_arrays(offsets, c.chunk(0)) for c in flat.columns]
            return pa.RecordBatch.from_arrays([pa.array(shard[order][heads], pa.int32()), *lists], schema=_LISTS)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for flat, starts, ends, of, piece, words, owned, n in phrases.of(batch):
                own, fine = words, np.ones(len(words), bool)
                for size, known in enumerate(bits, 1):
                    if size > 1:
                        own = grown(own, words, size)
                        m = len(own)
                        fine = fine[:m] & fine[1 : m + 1] & (piece[:m] == piece[size - 1 : size - 1 + m])
                    fine = fine & _hits(own, known)
                    at = np.flatnonzero(fine & owned[: len(own)])
                    order = at[np.argsort(own[at], kind="stable")]
                    if not len(order):
                        continue
                    heads = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
                    sums = np.add.reduceat(n[order], heads)
                    for i, h, f in zip(order[heads].tolist(), own[order][heads].tolist(), sums.tolist(), strict=True):
                        if (size, h) in held:
                            held[size, h][3] += f
                        else:
                            text = b" ".join(flat[starts[i] : ends[i + size - 1]].replace(b"\t", b" ").split(b" "))
                            held[size, h] = [langs[of[i]], b" ".join(w for w in text.split(b" ") if w), size, f]
                if len(held) > HELD // 4:
                    yield out()
                    held = {}
        if held:
            yield out()

    def merged(table: pa.Table) -> pa.Table:
        flat = pa.table([table[f.name].combine_chunks().flatten() for f in _PHRASES], schema=_PHRASES)
        sums = flat.group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")]).rename_columns(_PHRASES.names)
        return sums.filter(pc.field("f") >= least)

    lists = "shard int, lang array<string>, phrase array<binary>, size array<int>, f array<long>"
    return dictionary.mapInArrow(found, lists).groupBy("shard").applyInArrow(merged, "lang string, phrase binary, size int, f long")


def frequent_phrases(docs: DataFrame, longest: int = TRIGGER + 1, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Words and phrases that occur at least `least` times in a language (lang, phrase, size, f), and all words by language (of, n).

    Texts and languages may be null (an empty text, the language `und`); repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark)}/parse-{uuid.uuid4().hex}"
    parse(docs).write.parquet(folder)
    dictionary = spark.read.parquet(folder)
    shards = int((dictionary.agg(F.sum("words")).first()[0] or 0) // SHARD) + 8
    totals = cut(dictionary.groupBy(F.col("lang").alias("of")).agg(F.sum(F.col("words") * F.col("n")).alias("n")))
    read, bits = dictionary.select("lang", "chunk", "words", "n"), []
    for size in range(1, longest + 1):
        bits.append(id_bitmap(_frequent(read, size, least, bits[-1] if bits else None, shards)))
        if not bits[-1].any():
            break
    exact = _phrases(read, bits, least, shards)
    return cut(exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "f")), totals


def collocations(docs: DataFrame, longest: int = TRIGGER + 1, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score (all numbers long).

    A phrase has 2 to `longest` words (at most 5) inside a piece and occurs at least `least` times (a). A cut's score is
    floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits; of equal scores the first cut counts. Phrases inside a
    longer one that is as frequent go. Null texts are empty, a null language is `und`, repeated rows count each time, and tables
    without words give no rows. Only `text` and `lang` are read.
    """
    if not 2 <= longest <= TRIGGER + 1:
        raise ValueError(f"phrases have 2 to {TRIGGER + 1} words")
    known, totals = frequent_phrases(docs, longest, least)
    c, words = F.col, F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    candidates = known.filter(c("size") > 1).withColumnRenamed("f", "a")

    spans = candidates.filter(c("size") > 2).select("lang", "a", "phrase", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    spans = spans.withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)")))
    inside = spans.select("lang", "a", joined(c("at"), c("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").filter(c("longer").isNull() | (c("longer") < c("a"))).drop("longer")

    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), c("k")).alias("head"), joined(c("k") + 1, c("size") - c("k")).alias("tail"))
    part = known.select(c("lang").alias("of"), c("phrase").alias("part"), c("f").alias("count"))
    for name, to in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(part, (c("lang") == c("of")) & (c(name) == c("part"))).withColumnRenamed("count", to).drop("of", "part", name)
    total = F.broadcast(totals) if totals.count() <= FEW_LANGS else totals
    scored = cuts.join(total, c("lang") == c("of")).drop("of").withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    out = lowest.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(c("score").desc(), c("a").desc(), "phrase"))
    return out.withColumn("rank", rank).filter(c("rank") <= top).select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
