"""A quality classifier by nearest-neighbour voting in a latent space.

Every text becomes a vector of counts: shapes (triples of character classes: lower, upper, digit, blank, line end, each kind of
punctuation), words hashed to buckets, and how much of it repeats. Counts are damped by a logarithm and weighted by inverse document
frequency. A truncated decomposition of the labelled vectors (latent semantic analysis) gives the latent axes. The latent
vectors of the labelled texts are sent to every task, REFERENCES of them at most, and every document is compared with all of
them: exact cosines, a block of documents at a time. The NEIGHBOURS most similar vote with weights that grow with similarity.

Nothing but the text enters a vector: no id, language, source or length in characters.

Scale: labelled texts are measured once (a bounded sample of them, by a hash of the id); all documents pass once through one narrow
step, whose cost per document is fixed by REFERENCES. The driver holds REFERENCES * FEATURES numbers.

Nulls, empty and odd input: null and empty texts have the zero vector and get the share of good labels. Labels that are null are not
read; a document labelled both ways counts as bad. Rows with a null id are scored, held_out null. Repeated rows give
repeated results; other columns are never read; an empty table gives no rows; without labels every score is 0.5. Texts are
read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import WordHashes, map_texts, remainder
from sitefit.llm.quality_rules import repeated_words

#: Labelled texts that are kept as references, at most.
REFERENCES = 6000
#: Buckets of shapes and of words, and latent axes.
SHAPES, WORDS, AXES = 512, 256, 32
#: Voters, and the power of the similarity that weighs them.
NEIGHBOURS, SHARPNESS = 15, 8
#: The latent axes are found for this many columns.
FEATURES = SHAPES + WORDS + 4

#: Character classes of bytes: lower, upper, digit, blank, line end, other ASCII each by itself, bytes of other scripts.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _CLASS[_b] = (0 if 97 <= _b <= 122 or _b >= 128 else 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b in (32, 9) else 4 if _b in (10, 13) else 5 + _b % 32 if _b < 128 else 0)


def vector(text: bytes, hashes: np.ndarray) -> np.ndarray:
    """Shares of shapes, of word buckets and of repetition, damped."""
    out = np.zeros(FEATURES, np.float32)
    if not len(text):
        return out
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    if len(kind) > 2:
        shapes = (kind[:-2] * 1369 + kind[1:-1] * 37 + kind[2:]) * 40503 % 65521 % SHAPES
        out[:SHAPES] = np.bincount(shapes, minlength=SHAPES) / len(shapes)
    n = len(hashes)
    if n:
        out[SHAPES : SHAPES + WORDS] = np.bincount((hashes % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / n
        out[-4:] = ((hashes[1:] == hashes[:-1]).sum() / n, repeated_words(hashes) / n, len(np.unique(hashes)) / n, 1 / n)
    return np.log1p(100 * out)


class Space:
    """The latent axes and the labelled references."""

    def __init__(self, rows: np.ndarray, good: np.ndarray) -> None:
        seen = (rows > 0).sum(0)
        self.weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        weighted = rows * self.weight
        self.centre = weighted.mean(0)
        _, axes = np.linalg.eigh((weighted - self.centre).T @ (weighted - self.centre))
        self.axes = axes[:, ::-1][:, :AXES].astype(np.float32)
        self.good, self.prior = good.astype(np.float32), float(good.mean())
        self.references = self.latent(rows)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.weight - self.centre) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest references."""
        cosines = self.latent(rows) @ self.references.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6) ** SHARPNESS
        return np.where(np.abs(rows).sum(1) > 0, (weights * self.good[near]).sum(1) / weights.sum(1), self.prior)


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, vector) of every row."""

    def step():
        words = WordHashes()
        return lambda ids, texts: {"doc_id": ids, "vector": [vector(t or b"", h) for t, h in zip(texts, words.of_all(texts), strict=True)]}

    return map_texts(docs, step, "doc_id long, vector array<float>")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, divisor: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most about `most` labelled documents that aren't held out, chosen by a hash of the id."""
    c = F.col
    marks = labels.filter(c("doc_id").isNotNull() & c(column).isNotNull()).groupBy(c("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("label"))
    marks = marks.filter(remainder(c("doc_id"), divisor) != held)
    n = marks.count()
    if n > most:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most / n))
    return docs.select(c("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.limit(2 * most)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, divisor: int, held: int, references: int = REFERENCES) -> Space | None:
    """The space of a bounded sample of labelled documents; None without any."""
    sample = labelled_sample(docs, labels, "quality", divisor, held, references)
    # repeated rows of an id are one reference, and an id of many texts can't pass the bound
    found = vectors(sample.select("doc_id", "text")).withColumn("copy", F.xxhash64("doc_id", "vector")).dropDuplicates(["copy"])
    found = found.join(sample.select("doc_id", "label").distinct(), "doc_id").orderBy("copy").limit(2 * references).orderBy("doc_id", "copy").toArrow()
    if not found.num_rows:
        return None
    rows = np.stack([np.asarray(x, np.float32) for x in found.column("vector").to_numpy()])
    return Space(rows, found.column("label").to_numpy())


def scores(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels are learned only where crc32(id) modulo `divisor` isn't `held`."""
    space = fit(docs, labels, divisor, held)

    def step():
        words = WordHashes()

        def work(ids: list, texts: list) -> dict:
            if space is None:
                return {"doc_id": ids, "score": [0.5] * len(ids)}
            rows = np.stack([vector(t or b"", h) for t, h in zip(texts, words.of_all(texts), strict=True)]) if ids else np.zeros((0, FEATURES), np.float32)
            return {"doc_id": ids, "score": space.vote(rows).astype(float)}

        return work

    found = map_texts(docs, step, "doc_id long, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
