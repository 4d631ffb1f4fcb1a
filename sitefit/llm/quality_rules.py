"""Quality rules whose cutoffs are learned with a guarantee on how many good documents they reject.

Fixed base rules reject texts of fewer than MIN_WORDS words, and those more than half of whose words lie in repeated 3-word
windows. The learned part measures six ratios per text, each divided by a reference value; a document's strain is the
largest. A stratum (by default the language) gets one cutoff for the strain out of a grid.

Risk control. Labelled good documents of the stratum are the holdout; the cutoff has no parameter that they trained. For a
cutoff, the good documents that it would reject are counted, and the hypothesis "more than `risk` of the good documents are
rejected" is tested with the exact binomial tail P(X <= count | n, risk). The grid is walked from the laxest cutoff to the
strictest and stops at the first hypothesis that stands (fixed-sequence testing, which needs no correction within a
stratum); strata share the error `delta` equally (Bonferroni). So with probability 1 - delta no stratum loses more than
`risk` of its good documents to the learned rules. A stratum with too few labelled documents gets no cutoff.

Scale: one narrow Python pass measures texts; labels join the measures by id; counts by stratum are a small aggregate, and
strata stay a table (they are never collected).

Nulls, empty and odd input: a null or empty text has no words and fails the base rules. A null stratum is a stratum of its
own. Labels that are null are not read; a document labelled both ways counts as not good. Rows with a null id are measured
and judged, but have no label. Repeated rows give repeated results. Empty tables give no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import WordHashes, mixed, steps
from sitefit.session import cut

#: Base rules.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Ratios and the values they are measured against: symbols and bangs a word, upper-case and digit shares of characters,
#: repeated lines, words equal to the word before.
REFERENCE = {"symbols": 0.2, "bangs": 0.2, "upper": 0.3, "digits": 0.3, "lines": 0.3, "stutter": 0.2}
#: Cutoffs for the strain, laxest first.
GRID = (16.0, 12.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)
#: Good documents that a stratum may lose to the learned rules, and the chance that any stratum loses more.
RISK, DELTA = 0.01, 0.05

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

MEASURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, strain double"


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    key = hashes[:n]
    for k in range(1, width):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    start = counts[at] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : n + k] |= start
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The base measures and the strain of every text."""
    names = [part.split()[0] for part in MEASURES.split(", ")] + ["copy"]
    kinds = pa.schema([(n, pa.string() if n == "stratum" else pa.float64() if n == "strain" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(lower=False)
        for part in steps(batches):
            texts = [text or b"" for text in part.column(2).to_pylist()]
            rows = []
            for text, hashes in zip(texts, words.of_all(texts), strict=True):
                n, chars = len(hashes), len(text.translate(None, _BLANKS).decode())
                symbols, dup_lines = len(text) - len(text.translate(None, _SYMBOLS)), repeated_lines(text)
                upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                figures = len(text) - len(text.translate(None, b"0123456789"))
                ratios = {"symbols": symbols / max(n, 1), "bangs": (text.count(b"!") + text.count(b"?")) / max(n, 1), "upper": upper / max(chars, 1), "digits": figures / max(chars, 1),
                          "lines": dup_lines / max(text.count(b"\n") + 1, 1), "stutter": float((hashes[1:] == hashes[:-1]).sum()) / max(n, 1)}
                rows.append((n, chars, symbols, dup_lines, repeated_words(hashes), max(ratios[k] / top for k, top in REFERENCE.items())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t.type) for x, t in zip(columns, list(kinds)[2:-1], strict=True)), part.column(3)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("binary"), F.xxhash64("text").alias("copy")).mapInArrow(run, MEASURES + ", copy long")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X of n trials of chance p."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def chosen(n: int, lost: list[int], risk: float, level: float) -> float | None:
    """The strictest cutoff of the grid before the first that isn't proven to lose at most `risk`. lost: good documents above each."""
    found = None
    for cutoff, count in zip(GRID, lost, strict=True):
        if tail(count, n, risk) > level:
            break
        found = cutoff
    return found


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff, n_good): the learned cutoff of each stratum with labelled good documents, null where none is proven."""
    c = F.col
    good = labels.filter("quality is not null and doc_id is not null").groupBy(c("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good")).filter("good = 1")
    held = measures.filter(~_base_failed()).join(good, "doc_id", "left_semi")
    counts = cut(held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(c("strain") > top) for top in GRID]).alias("lost")))
    level = delta / max(1, counts.count())
    kinds = pa.schema([("stratum", pa.string()), ("cutoff", pa.float64()), ("n_good", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, lost = part.column(1).to_pylist(), part.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([chosen(a, b, risk, level) for a, b in zip(n, lost, strict=True)], pa.float64()), pa.array(n, pa.int64())], schema=kinds)

    return counts.mapInArrow(run, "stratum string, cutoff double, n_good long")


def _base_failed():
    c = F.col
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, copies: bool = False) -> DataFrame:
    """Every document's measures (with `copies`, a hash of its text too), `base_failed`, the strain, its stratum's cutoff (null: none) and `kept`."""
    c = F.col
    measures = cut(measured(docs, stratum))
    limits = cutoffs(measures, labels, risk, delta).withColumnRenamed("stratum", "stratum_")
    rows = measures.join(limits, c("stratum").eqNullSafe(c("stratum_")), "left").withColumn("base_failed", _base_failed())
    return rows.withColumn("kept", ~c("base_failed") & (c("cutoff").isNull() | (c("strain") <= c("cutoff")))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "strain", "cutoff", *(["copy"] if copies else []))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns: each text of a repeated id by its own verdict. Rows whose id is null stay."""
    c = F.col
    # the verdict of a text is that of its measures; ids are looked up in `labels`, so texts of an id are told apart by a hash beside it
    verdict = judged(docs, labels, stratum, copies=True).filter("kept and doc_id is not null").select(c("doc_id").alias("id_"), c("copy").alias("copy_"), c("stratum").alias("stratum_")).distinct()
    same = (docs["doc_id"].cast("long") == c("id_")) & (F.xxhash64(docs["text"]) == c("copy_")) & docs[stratum].cast("string").eqNullSafe(c("stratum_"))
    return docs.join(verdict, same, "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
