"""A Katz back-off language model of the corpus, and the scores of all texts under it.

A bigram model over words (lower-cased A-Z) with an end token: p(w | h) is the Good-Turing discounted share of the pair
where the training texts have it, else alpha(h) * p(w) with the discounted unigram p(w), whose freed mass goes to one
unknown word. alpha(h) is normalised exactly over the whole vocabulary: the mass the seen pairs of h leave, divided by the
unigram mass of the words not seen after h. A text's score adds log10 p over its tokens.

Tables. Unigram counts are one table keyed by word. Bigram counts lie in shards of about equal size, keyed by the context, but
for the most frequent contexts, whose pairs are spread over all shards by the pair. Both are made from
all training texts; nothing is pruned. What is broadcast is bounded: the HOT most frequent words with their counts, and the
statistics of the SPREAD contexts. Words outside the hot list are looked up by joins with the unigram table.

Passes: count words; look up rare words (a join); pack pair occurrences into compressed rows per block of text and shard, one
shuffle; per shard, in numpy, statistics for the counts of counts and the spread contexts; per shard, scores; sums by document, which go in as many
buckets of ids as there are shards (a bucket gets no more entries than a shard has pairs).
A shard holds a bounded share of the pairs: only the single most frequent pair types can make it larger, and these are
added up within each block and document before they are shuffled.

Words are told apart by 64-bit hashes.

Nulls, empty and odd input: null, empty and blank texts are the end token alone. Rows with a null id neither
train nor give a row. Rows with the same id are one document whose texts are counted one after the other, and give one
row. Other columns are never read. Without training texts every word is unknown; the unigram is then uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import WordHashes, mixed, remainder, steps
from sitefit.session import cut

#: Words whose counts every task holds; contexts whose pairs are spread over all shards.
HOT, SPREAD = 1 << 19, 1 << 12
#: Tokens a task gathers before it writes out word counts, or a block of pairs, and tokens a shard should get.
BLOCK_TOKENS, PAIR_TOKENS, SHARD_TOKENS = 1 << 21, 1 << 20, 3 << 19
#: Counts up to this are discounted.
KEEP_ABOVE = 5

END, BEGIN = np.uint64(0), np.uint64(1)  # codes of the end token and of the text's beginning
COLD_BIT = np.uint64(1 << 63)


def squeezed(columns: list[np.ndarray]) -> bytes:
    """64-bit columns of one length as bytes: planes of equal byte weight, compressed."""
    planes = np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(blob: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(columns, -1).view(np.uint64)


class Codes:
    """Codes of words: rank + 2 for hot words, the hash with its top bit set for all others."""

    def __init__(self, hot: np.ndarray) -> None:
        order = np.argsort(hot)
        self.keys, self.rank = hot[order], order.astype(np.uint64) + np.uint64(2)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return hashes | COLD_BIT
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.rank[at], hashes | COLD_BIT)


def shard_of(a: np.ndarray, b: np.ndarray, shards: int, spread: int) -> np.ndarray:
    """Pairs of one context lie together, but for the `spread` hottest contexts and the text's beginning."""
    wide = (a < np.uint64(spread + 2))
    return (mixed(np.where(wide, mixed(a) + b, a)) % np.uint64(shards)).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): training count of every word of the table, 0 for words of held-out texts only."""
    kinds = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, weights, held = WordHashes(), [], [], 0

        def report() -> pa.RecordBatch:
            flat = np.concatenate([np.empty(0, np.uint64), *block]) | COLD_BIT
            found, at = np.unique(flat, return_inverse=True)
            n = np.bincount(at, np.concatenate([np.empty(0), *weights]), len(found))
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=kinds)

        for part in steps(batches):
            for train, hashes in zip(part.column(1).to_pylist(), words.of_all(part.column(2).to_pylist()), strict=True):
                block.append(hashes)
                weights.append(np.full(len(hashes), float(bool(train))))
                held += len(hashes)
            if held >= BLOCK_TOKENS:
                yield report()
                block, weights, held = [], [], 0
        yield report()

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def document_pairs(words: WordHashes, codes: Codes, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its distinct pairs (context, word) as codes, and how often each occurs."""
    for hashes in words.of_all(texts):
        tokens = np.concatenate([[BEGIN], codes.of(hashes | COLD_BIT), [END]]).astype(np.uint64)
        a, b = tokens[:-1], tokens[1:]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        yield a[first], b[first], np.diff(np.append(first, len(a)))


PACKED = "shard long, kind int, doc_id long, a long, b long, n long, blob binary"


def _packed(rows: DataFrame, hot: np.ndarray, shards: int, cold: bool) -> DataFrame:
    """Pair occurrences by shard. cold: those whose word is not hot, a row each; else the others, in blobs, and a row per text.

    A blob has the columns a, b, doc_id and 2 * n + (1 if the text trains).
    """
    kinds = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def batch(shard, kind, doc_id, a, b, n, blob) -> pa.RecordBatch:
        count = len(shard)
        columns = [pa.array(shard, pa.int64()), pa.array(np.full(count, kind, np.int32))]
        columns += [pa.nulls(count, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (doc_id, a, b, n)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(count, pa.binary()) if blob is None else pa.array(blob, pa.binary())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes = WordHashes(), Codes(hot)
        held: list[list[np.ndarray]] = [[], [], [], []]
        tokens = 0

        def report() -> Iterator[pa.RecordBatch]:
            a, b, doc, n = (np.concatenate(x) for x in held)
            shard = shard_of(a, b, shards, SPREAD)
            if cold:
                yield batch(shard, 1, doc.view(np.int64), a.view(np.int64), b.view(np.int64), n.astype(np.int64), None)
                return
            order = np.lexsort((b, a, shard))
            a, b, doc, n, shard = a[order], b[order], doc[order], n[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            ends = [*first[1:].tolist(), len(shard)]
            yield batch(shard[first], 0, None, None, None, None, [squeezed([x[s:e] for x in (a, b, doc, n)]) for s, e in zip(first.tolist(), ends, strict=True)])

        for part in steps(batches):
            ids, train = part.column(0).to_pylist(), part.column(1).to_pylist()
            sizes = []
            for doc_id, trains, (a, b, n) in zip(ids, train, document_pairs(words, codes, part.column(2).to_pylist()), strict=True):
                sizes.append(int(n.sum()))
                if doc_id is None:
                    continue
                chosen = (b >= COLD_BIT) == cold
                doc = np.full(int(chosen.sum()), doc_id, np.int64).view(np.uint64)
                for k, x in enumerate((a[chosen], b[chosen], doc, (2 * n[chosen] + bool(trains)).astype(np.uint64))):
                    held[k].append(x)
                tokens += sizes[-1]
            if not cold:
                known = [(i, s) for i, s in zip(ids, sizes, strict=True) if i is not None]
                yield batch([i % shards for i, _ in known], 2, [i for i, _ in known], None, None, [s for _, s in known], None)
            if tokens >= PAIR_TOKENS:
                yield from report()
                held, tokens = [[], [], [], []], 0
        if tokens:
            yield from report()

    return rows.mapInArrow(run, PACKED)


class Model:
    """What is the same for all shards: hot counts, the unigram and the discounts. Small and of bounded size."""

    def __init__(self, hot_n: np.ndarray, ends: int, total: int, types: int, of_counts: dict[int, int]) -> None:
        self.hot_n, self.ends, self.total, self.types = hot_n, ends, total, types
        self.share = discounts(of_counts)
        # the discounted counts and the unknown word add up to one; where nothing is freed, one count more is
        freed = sum((1 - self.share[r]) * r * of_counts.get(r, 0) for r in range(1, KEEP_ABOVE + 1))
        grown = 0 if freed > 0 else 1
        self.unknown, self.divisor = (freed or 1.0) / (total + grown), total + grown

    def unigram(self, n: np.ndarray) -> np.ndarray:
        """p(w) for words of these training counts; all words that were never seen are one."""
        share = np.array([1.0, *(self.share[r] for r in range(1, KEEP_ABOVE + 1)), 1.0])
        return np.where(n > 0, share[np.minimum(n, KEEP_ABOVE + 1)] * n / self.divisor, self.unknown)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Training counts of codes that are hot, the end or the beginning."""
        table = np.concatenate([[self.ends, self.ends], self.hot_n])
        return table[np.minimum(codes, np.uint64(len(table) - 1)).astype(np.int64)]


def discounts(of_counts: dict[int, int]) -> dict[int, float]:
    """Katz's discount for counts 1 to KEEP_ABOVE from the counts of counts; absolute discounting where these don't allow it."""
    n = {r: of_counts.get(r, 0) for r in range(1, KEEP_ABOVE + 2)}
    over = (KEEP_ABOVE + 1) * n[KEEP_ABOVE + 1] / n[1] if n[1] else 1.0
    turing = {r: ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if n[r] and over < 1 else -1.0 for r in range(1, KEEP_ABOVE + 1)}
    step = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return {r: d if 0 < d < 1 else (r - step) / r for r, d in turing.items()}


class Shard:
    """The pairs of one shard: types (a, b) with training counts, and the occurrences that made them."""

    def __init__(self, columns: list[np.ndarray], model: Model) -> None:
        order = np.lexsort((columns[1], columns[0]))
        for k in range(len(columns)):
            columns[k] = columns[k][order]
        a, b, doc, n, cold_n = columns
        columns.clear()
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.flatnonzero(fresh)
        self.at = (np.cumsum(fresh) - 1).astype(np.int32)  # type of each occurrence
        self.doc, self.times = doc.view(np.int64), (n >> np.uint64(1)).astype(np.int32)
        self.a, self.b = a[first], b[first]
        self.c = np.add.reduceat(np.where(n & np.uint64(1), self.times, 0), first).astype(np.int64)
        self.cb = np.where(self.b >= COLD_BIT, cold_n[first], model.counts(self.b))
        heads = np.concatenate([[True], self.a[1:] != self.a[:-1]])
        self.group, self.heads = np.cumsum(heads) - 1, np.flatnonzero(heads)
        self.wide = self.a[self.heads] < np.uint64(SPREAD + 2)
        self.p1 = model.unigram(self.cb)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each type by context."""
        return np.add.reduceat(values, self.heads)


def shards_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[Shard]:
    """The shards of a partition, one after the other."""
    blobs: dict[int, list] = {}
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        kind = columns[1].to_numpy()
        shard = columns[0].to_numpy()
        for k in np.flatnonzero(kind == 0).tolist():
            blobs.setdefault(int(shard[k]), []).append(columns[6][k].as_py())
        rows = np.flatnonzero(kind == 1)
        if len(rows):
            flat = [columns[k].take(pa.array(rows)).to_numpy() for k in (3, 4, 2, 5, 7)]  # no nulls among these
            for s in np.unique(shard[rows]).tolist():
                blobs.setdefault(int(s), []).append([x[shard[rows] == s] for x in flat])
    while blobs:
        _, parts = blobs.popitem()
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        while parts:
            part = parts.pop()
            if isinstance(part, bytes):
                part = unsqueezed(part, 4)
                part = [*part, np.zeros(part.shape[1], np.int64)]
            for k, x in enumerate(part):
                found[k].append(x.view(np.uint64) if k < 4 else x)
        columns = []
        while found:
            columns.append(np.concatenate(found.pop(0)))
        yield Shard(columns, model)


STATS = "a long, r0 long, r1 long, r2 long, r3 long, r4 long, r5 long, r6 long, above long, seen_mass double"


def pair_statistics(shards: DataFrame, model: Model) -> DataFrame:
    """Per spread context, and over all contexts (a = -1): pair types by count 1..6, tokens of counts above 5, unigram mass of seen words."""
    kinds = pa.schema([(part.split()[0], pa.float64() if part.endswith("double") else pa.int64()) for part in STATS.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards_of(batches, model):
            r = np.minimum(shard.c, KEEP_ABOVE + 2)
            by = np.stack([shard.sums((r == k).astype(np.int64)) for k in range(KEEP_ABOVE + 2)])
            above = shard.sums(np.where(shard.c > KEEP_ABOVE, shard.c, 0))
            mass = shard.sums(np.where(shard.c > 0, shard.p1, 0.0))
            w = shard.wide
            columns = [np.append(shard.a[shard.heads][w].view(np.int64), -1), *(np.append(x[w], x.sum()) for x in by), np.append(above[w], above.sum()), np.append(mass[w], 0.0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kinds)

    return shards.mapInArrow(run, STATS).groupBy("a").agg(*(F.sum(name).alias(name) for name in kinds.names[1:]))


def backoff(seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """alpha: the mass that seen pairs leave, over the unigram mass of the words not seen after the context."""
    return np.maximum(1.0 - seen, 1e-12) / np.maximum(1.0 - mass, 1e-12)


def pair_scores(shards: DataFrame, model: Model, share: dict[int, float], wide_n: np.ndarray, wide_alpha: np.ndarray, buckets: int) -> DataFrame:
    """(doc_id, score, base, known): sums over a document's tokens within each shard, packed by bucket of ids, and added up."""
    kinds = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("base", pa.float64()), ("known", pa.int64())])
    packed = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
    kept = np.concatenate([[0.0], [share[r] for r in range(1, KEEP_ABOVE + 1)], [1.0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards_of(batches, model):
            total = s.sums(s.c).astype(float)
            total[s.wide] = wide_n[s.a[s.heads][s.wide].astype(np.int64)]
            freed = kept[np.minimum(s.c, KEEP_ABOVE + 1)] * s.c
            held = s.sums(freed)
            # a context that leaves nothing gives up one count
            grown = np.where(~s.wide & (held >= total) & (total > 0), 1.0, 0.0)
            alpha = np.where(total > 0, backoff(held / np.maximum(total + grown, 1), s.sums(np.where(s.c > 0, s.p1, 0.0))), 1.0)
            alpha[s.wide] = wide_alpha[s.a[s.heads][s.wide].astype(np.int64), 0]
            grown[s.wide] = wide_alpha[s.a[s.heads][s.wide].astype(np.int64), 1]
            p = np.where(s.c > 0, freed / np.maximum((total + grown)[s.group], 1), alpha[s.group] * s.p1)
            each = np.log10(p)
            base = np.log10((s.cb + 1.0) / (model.total + 1.0 * (model.types + 1)))
            docs, at = np.unique(s.doc, return_inverse=True)
            sums = [np.bincount(at, s.times * x, len(docs)) for x in (each[s.at], base[s.at], (s.cb > 0)[s.at].astype(float))]
            columns = [docs.view(np.uint64), sums[0].view(np.uint64), sums[1].view(np.uint64), sums[2].astype(np.uint64)]
            bucket = (mixed(columns[0]) % np.uint64(buckets)).astype(np.int64)
            found = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])
            rows = [(k, squeezed([x[chosen] for x in columns])) for k, chosen in enumerate(found) if len(chosen)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=packed)

    def add(group: pa.Table) -> pa.Table:
        parts = [unsqueezed(blob, 4) for blob in group.column("blob").to_pylist()]
        docs, at = np.unique(np.concatenate([p[0] for p in parts]).view(np.int64), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([p[k] for p in parts]).view(np.float64), len(docs)) for k in (1, 2)]
        known = np.bincount(at, np.concatenate([p[3] for p in parts]).astype(float), len(docs)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(docs), pa.array(sums[0]), pa.array(sums[1]), pa.array(known)], schema=kinds)

    return shards.mapInArrow(run, "bucket long, blob binary").groupBy("bucket").applyInArrow(add, "doc_id long, score double, base double, known long")


def katz_scores(docs: DataFrame, divisor: int = 7, held: int = 2, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Texts whose crc32(doc_id as text) modulo `divisor` is `held` are held out of the counts. `base_score` is the add-one
    unigram's log10 probability, `score` the model's; `n_known` counts tokens with a training count.
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(c("doc_id"), divisor) != held, F.lit(False)).alias("train"), c("text").cast("binary").alias("text"))
    words = cut(word_counts(rows))
    trained = words.filter("n > 0")
    # counts one by one up to 64, then in steps of a sixteenth of a power of two: a bounded list
    step = F.when(c("n") <= 64, c("n").cast("double")).otherwise(64 + F.floor(16 * F.log2(c("n") / 64.0)))
    found = sorted(trained.groupBy(step.alias("step")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect(), reverse=True)
    ends = rows.filter("train").count()
    of_counts = {int(r["step"]): r["types"] for r in found if r["step"] <= KEEP_ABOVE + 1}
    if 0 < ends <= KEEP_ABOVE + 1:
        of_counts[ends] = of_counts.get(ends, 0) + 1
    total, types = sum(r["tokens"] for r in found) + ends, sum(r["types"] for r in found) + (1 if ends else 0)
    room = np.cumsum([0, *(r["types"] for r in found)])
    lowest = [r["least"] for r, upto in zip(found, room[1:], strict=True) if upto <= HOT]
    top = trained.filter(c("n") >= lowest[-1]).toArrow().to_pydict() if lowest else {"word": [], "n": []}
    order = np.lexsort((np.array(top["word"], np.int64), -np.array(top["n"], np.int64)))
    hot = np.array(top["word"], np.int64)[order].view(np.uint64)
    model = Model(np.array(top["n"], np.int64)[order], ends, total, types, of_counts)
    shards = shards or max(12, -(-total // SHARD_TOKENS))

    rare = _packed(rows, hot, shards, cold=True).join(words.select(c("word").alias("b"), c("n").alias("bn")), "b", "left")
    rare = rare.select("shard", "kind", "doc_id", "a", "b", "n", "blob", F.coalesce("bn", F.lit(0)).alias("bn"))
    packed = cut(_packed(rows, hot, shards, cold=False).withColumn("bn", F.lit(0).cast("long")).unionByName(rare).repartition(shards, "shard"))
    pairs = packed.filter("kind < 2")

    stats = pair_statistics(pairs, model).collect()  # the spread contexts and one row more
    names = [f"r{r}" for r in range(1, KEEP_ABOVE + 2)]
    whole = next((r for r in stats if r["a"] == -1), None)
    share = discounts({k + 1: whole[n] for k, n in enumerate(names)} if whole else {})
    wide = min(SPREAD, len(hot)) + 2
    wide_n = np.maximum(model.counts(np.arange(wide).astype(np.uint64)).astype(float), 0)
    wide_alpha = np.tile([1.0, 0.0], (wide, 1))
    for r in stats:
        if 0 <= r["a"] < wide and wide_n[r["a"]] > 0:
            kept = r["above"] + sum(share[k + 1] * (k + 1) * r[n] for k, n in enumerate(names[:KEEP_ABOVE]))
            grown = 1.0 if kept >= wide_n[r["a"]] else 0.0
            wide_alpha[r["a"]] = [float(backoff(np.array(kept / (wide_n[r["a"]] + grown)), np.array(r["seen_mass"]))), grown]

    sums = pair_scores(pairs, model, share, wide_n, wide_alpha, shards)
    sizes = packed.filter("kind = 2").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))
    known = sizes.join(sums, "doc_id", "left")
    return known.select("doc_id", (remainder(c("doc_id"), divisor) == held).alias("held_out"), "n_tokens", c("known").alias("n_known"),
                        F.lit(total).cast("long").alias("train_tokens"), c("base").alias("base_score"), "score")
