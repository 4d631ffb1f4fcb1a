"""Packing documents into training sequences of several context sizes.

Hierarchical multi-length packing. Every document is tokenised and closed by a separator. Full windows of the longest tier
are cut off first; the rest of a document, shorter than that window, is routed to the smallest tier (context size) that
holds it. Tiers are packed from the longest down: each piece of a tier opens a window of that size, and the gap it
leaves is filled from the shorter tiers, whole pieces first (the largest that fits), then by cutting the shortest piece
that is left. So every sequence ends exactly at its tier's size and nothing is padded. What remains of a task at its end,
less than one window, is cut into powers of two. Finished sequences of a tier are dealt to step groups of equal tokens so
that the groups' attention costs (sum of squared piece lengths) are even.

Scale: one narrow pass, no shuffle. Each scan task packs its own documents and holds one block of pieces and one round of
step groups (both parameters), so memory doesn't grow with the task; a lost task gives the same ids when it is run again.

Nulls, empty and odd input: a null or empty text is the separator alone; a null id is kept; repeated rows are packed as
often as they occur; other columns are never read; an empty table gives no pieces. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import steps

#: Context sizes, shortest first; powers of two.
TIERS = (128, 256, 512, 1024)
#: Tokens in pieces that a task gathers before it packs them.
BLOCK_TOKENS = 1 << 20
#: Tokens of one step group, and groups balanced against each other at a time.
GROUP_TOKENS, GROUPS = 16_384, 4

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size long, step_group long"
_FIELDS = [part.split()[0] for part in SCHEMA.split(",")]


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    The file's merges are read as ranks for tiktoken, which gives the same ids several times as fast. Texts with characters
    whose class may differ between the two pattern libraries (beyond Latin script and common punctuation), texts with long runs of
    blanks (which tiktoken's pattern walks back over on a bounded stack), and files whose merges aren't in the order of their ids,
    go through `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(map(shown.__getitem__, token)): k for token, k in model["vocab"].items() if set(token) <= shown.keys()}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        self.ordered = all(model["vocab"][token] == 256 + k for k, token in enumerate(merged))
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: k for t, k in ranks.items() if k < 256 + len(merged)}, special_tokens={})
        self.odd = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u017f\u2013-\u2026]|[\t\n\r ]{1000}").search

    def whole(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.ordered or self.odd(text):
            return self.whole(text)
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


class Packer:
    """Packs pieces (doc_id, start, ids as bytes, tokens of the document) of one task into full windows."""

    def __init__(self, tiers: tuple[int, ...], first_id: int) -> None:
        self.tiers, self.longest = tiers, tiers[-1]
        self.pool: list[list] = [[] for _ in range(self.longest + 1)]  # pieces by length
        self.there = 0  # bit n: there is a piece of n tokens
        self.held = 0
        self.next_sequence = self.next_group = first_id
        self.waiting: dict[int, list] = {size: [] for size in tiers}
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total - total % self.longest, self.longest):
            self.close([(doc_id, start, ids[4 * start : 4 * (start + self.longest)], total)], self.longest)
        if rest := total % self.longest:
            self.put((doc_id, total - rest, ids[4 * (total - rest) :], total))

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pool[n].append(piece)
        self.there |= 1 << n
        self.held += n

    def take(self, n: int) -> tuple:
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.there &= ~(1 << n)
        self.held -= n
        return piece

    def cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)

    def pack(self, last: bool) -> None:
        """Packs what is held; an unfinished window goes back, or into powers of two at the end."""
        while self.there:
            longest = self.there.bit_length() - 1
            window, size = [self.take(longest)], next(t for t in self.tiers if t >= longest)
            gap = size - longest
            while gap and self.there:
                if fits := self.there & ((1 << (gap + 1)) - 1):
                    window.append(self.take(fits.bit_length() - 1))
                    gap -= len(window[-1][2]) // 4
                else:
                    head, tail = self.cut(self.take((self.there & -self.there).bit_length() - 1), gap)
                    window.append(head)
                    self.put(tail)
                    gap = 0
            if not gap:
                self.close(window, size)
            elif last:
                self.close_rest(window)
            else:
                for piece in window:
                    self.put(piece)
                return

    def close_rest(self, window: list[tuple]) -> None:
        """Cuts pieces that don't fill a window into sequences whose sizes are powers of two."""
        left = sum(len(piece[2]) // 4 for piece in window)
        window = window[::-1]
        while left:
            size, sequence, filled = 1 << (left.bit_length() - 1), [], 0
            while filled < size:
                piece = window.pop()
                n = len(piece[2]) // 4
                if n > size - filled:
                    piece, tail = self.cut(piece, size - filled)
                    window.append(tail)
                    n = size - filled
                sequence.append(piece)
                filled += n
            self.close(sequence, size)
            left -= size

    def close(self, window: list[tuple], size: int) -> None:
        waiting = self.waiting.setdefault(size, [])
        waiting.append((sum((len(p[2]) // 4) ** 2 for p in window), self.next_sequence, window))
        self.next_sequence += 1
        if len(waiting) >= GROUPS * max(1, GROUP_TOKENS // size):
            self.deal(size)

    def deal(self, size: int) -> None:
        """Deals waiting sequences to step groups: the costliest first, each to the cheapest group with room."""
        waiting, self.waiting[size] = sorted(self.waiting[size], key=lambda s: (-s[0], s[1])), []
        room = max(1, GROUP_TOKENS // size)
        groups = [[0, 0] for _ in range(-(-len(waiting) // room))]  # cost, sequences
        for cost, sequence, window in waiting:
            k = min((g for g in range(len(groups)) if groups[g][1] < room), key=lambda g: (groups[g][0], g))
            groups[k][0] += cost
            groups[k][1] += 1
            offset = 0
            for doc_id, start, ids, total in window:
                n = len(ids) // 4
                self.done.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset, size, self.next_group + k))
                offset += n
        self.next_group += len(groups)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, separator: int = 0) -> DataFrame:
    """One row per piece: where it lies in its document (`start`, `length`) and in its sequence (`sequence_id`, `offset`).

    `ids_crc32` is the checksum of the piece's ids (unsigned 32-bit, little-endian), `doc_tokens` counts the document's ids
    with the separator, `context_size` is the sequence's size and `step_group` the group of sequences it trains with.
    `tokenizer` is the path of a byte-level BPE file that every executor can open.
    """
    kinds = pa.schema([(name, pa.int64()) for name in _FIELDS])
    closing = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), Packer(tiers, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.done, strict=True)) or [()] * len(_FIELDS)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)

        for part in steps(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc_id, encoder.encode(text or "") + closing)
                if packer.held >= BLOCK_TOKENS:
                    packer.pack(last=False)
            if len(packer.done) > 20_000:
                yield rows()
        packer.pack(last=True)
        for size in list(packer.waiting):
            packer.deal(size)
        yield rows()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
