"""Toxicity scores from a learned lexicon whose misspellings are matched too.

Lexicon. Words of labelled training texts whose log-odds of toxicity are high and certain (a z-score) are terms; a short list of
plain insults is added with a modest weight. Terms form a trie, and the trie is intersected with the Levenshtein automaton
of one edit, which for longer terms may be a swap of neighbours: states are sets of (trie node, edits used), made into a deterministic automaton as words are read. A word that leaves the
automaton is rejected at once. Words known from harmless training texts are never taken for misspellings.

Context. A hit inside quotation marks of its line, or soon after a word of reporting, is a quotation. Hits close together add up: a text
has sums of term weights for plain, quoted and misspelt hits, its densest window of words, its number of different terms and
hits by length. A logistic model of these gives the score. Its coefficients are fitted on texts that took no part in a
lexicon made from the other half of the training texts; the lexicon used for scoring comes from both halves.

Only the text enters a score. Scale: labelled texts are counted in one pass and an aggregate over words; scoring is one narrow pass.
The driver holds TERMS terms, EXCEPTIONS words and FIT_ROWS rows of six numbers, all bounded.

Nulls, empty and odd input: null and empty texts have no hits and get the model's base score. Labels that are null are not read; a
document labelled both ways counts as toxic. Rows with a null id are scored, held_out null. Repeated rows give repeated
results; exact copies train once; other columns are never read; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import id_bitmap, in_bitmap, map_texts, remainder, steps
from sitefit.session import cut

#: Terms of the lexicon, words that are never misspellings, labelled rows the model is fitted on: at most.
TERMS, EXCEPTIONS, FIT_ROWS = 2000, 100_000, 20_000
#: Documents and certainty that make a word a term; letters that a term needs to be matched with an edit.
LEAST_DOCS, LEAST_Z, FUZZY_LETTERS = 3, 3.0, 5
#: Letters that a term needs to be matched with two neighbours swapped.
SWAP_LETTERS = 6
#: Words on either side of a hit that make its window; words after a reporting word that count as quoted.
WINDOW, REPORTED = 12, 6
#: Plain insults, known without labels, and their weight.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb", "bastard", "asshole", "bitch")
SEED_WEIGHT = 2.0
REPORTING = frozenset("said says wrote called calls quoted quote quoting reported saying sagte schrieb dit écrit dijo escribió".split())

_SPLIT = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+|[\"\n]")
#: Punctuation and blanks beyond ASCII, which end a word as those of ASCII do.
_MARKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u3003]")
_OPEN = {"“": 1, "«": 1, "„": 1, "”": -1, "»": -1}


def words_of(text: bytes | None) -> list[bytes]:
    return _MARKS.sub(" ", (text or b"").decode().lower().replace("\u0080", " ").replace("\u0081", " ")).encode().translate(_SPLIT).split()


class Matcher:
    """A trie of terms met with the Levenshtein automaton of one edit, made deterministic as it is used."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()) -> None:
        self.weights, self.exceptions = weights, exceptions
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(weights):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][letter]
            self.term[node] = term
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.memo: dict[bytes, tuple[str, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int | str]]) -> int:
        """The state of these positions and of those a left-out letter leads to; -1 for none."""
        found |= {(child, 1) for node, edits in found if edits == 0 for child in self.children[node].values()}
        found -= {(node, 1) for node, edits in found if edits == 0}
        if not found:
            return -1
        key = frozenset(found)
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.known[key]

    def _move(self, state: int, letter: str) -> int:
        # edits: 0, 1, 2 after a swap, or the letter that must come to end a swap
        found = set()
        for node, edits in self.states[state]:
            if isinstance(edits, str):
                if letter == edits:
                    found.add((node, 2))
                continue
            if letter in self.children[node]:
                found.add((self.children[node][letter], edits))
            if edits == 0:
                found.add((node, 1))
                found.update((child, 1) for child in self.children[node].values())
                found.update((self.children[child][letter], other) for other, child in self.children[node].items() if other != letter and letter in self.children[child])
        self.moves[state][letter] = self._state(found)
        return self.moves[state][letter]

    def find(self, word: bytes) -> tuple[str, int] | None:
        """The term that the word is (0) or misspells (1), if any."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 300_000 or len(self.states) > 50_000:
            self._fresh()
        state, letters = self.start, word.decode()
        for letter in letters:
            after = self.moves[state].get(letter)
            state = self._move(state, letter) if after is None else after
            if state < 0:
                break
        found = None
        if state >= 0:
            ends = [(edits, -self.weights[self.term[node]], self.term[node]) for node, edits in self.states[state]
                    if self.term[node] and not isinstance(edits, str) and (edits == 0 or len(self.term[node]) >= (FUZZY_LETTERS, SWAP_LETTERS)[edits - 1] and len(letters) >= FUZZY_LETTERS)]
            if letters in self.weights:
                found = (letters, 0)
            elif ends and letters not in self.exceptions:
                found = (min(ends)[2], 1)
        self.memo[word] = found
        return found

    def features(self, text: bytes | None) -> list[float]:
        words = words_of(text)
        hits = {w: found for w in set(words) if (found := self.find(w))}
        if not hits:
            return [0.0] * 6
        at, quoted, depth, mark, reported = -1, False, 0, False, -REPORTED - 1
        places: list[tuple[int, float]] = []
        sums = [0.0, 0.0, 0.0]
        for token in _TOKEN.findall(_quotes(text)):
            if token == "\n":
                depth, mark = 0, False
            elif token == '"':
                mark = not mark
            elif token in ("\u0080", "\u0081"):
                depth = max(0, depth + (1 if token == "\u0080" else -1))
            else:
                at += 1
                if token in REPORTING:
                    reported = at
                if found := hits.get(token.encode()):
                    weight, quoted = self.weights[found[0]], mark or depth > 0 or at - reported <= REPORTED
                    sums[1 if quoted else 2 if found[1] else 0] += weight
                    places.append((at, weight * (0.3 if quoted else 0.6 if found[1] else 1.0)))
        dense = _densest(places)
        plain = sum(w for _, w in places)
        return [np.log1p(sums[0]), np.log1p(sums[1]), np.log1p(sums[2]), float(np.log1p(dense)), float(np.log1p(len({t for t, _ in hits.values()}))), plain / sqrt(len(words) + 10.0)]


def _densest(places: list[tuple[int, float]]) -> float:
    """The greatest sum of weights within a window, of all windows that begin with a hit; places ascend."""
    if not places:
        return 0.0
    at = np.array([p for p, _ in places])
    sums = np.concatenate([[0.0], np.cumsum([w for _, w in places])])
    return float((sums[np.searchsorted(at, at + 2 * WINDOW, "right")] - sums[:-1]).max())


def _quotes(text: bytes) -> str:
    """Lower-cased text with typographic quotation marks as two private tokens of their own; other marks beyond ASCII become blanks."""
    lower = text.decode().lower().replace("\u0080", " ").replace("\u0081", " ")
    for sign, way in _OPEN.items():
        lower = lower.replace(sign, " \u0080 " if way > 0 else " \u0081 ")
    return _MARKS.sub(" ", lower)


def marks_of(labels: DataFrame, divisor: int, held: int) -> DataFrame:
    """(doc_id, toxic) of labelled ids that aren't held out."""
    c = F.col
    found = labels.filter("doc_id is not null and toxic is not null").groupBy(c("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return found.filter(remainder(c("doc_id"), divisor) != held)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, t0, o0, t1, o1): toxic and other training texts with the word, by half."""
    names = ["word", "t0", "o0", "t1", "o1"]
    kinds = pa.schema([(n, pa.string() if n == "word" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def report() -> pa.RecordBatch:
            table: dict[str, list[int]] = {}
            for (word, k), n in counts.items():
                table.setdefault(word.decode(), [0, 0, 0, 0])[k] = n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *(pa.array([x[k] for x in table.values()], pa.int64()) for k in range(4))], schema=kinds)

        for part in steps(batches):
            for text, toxic, half in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                k = 2 * half + (0 if toxic else 1)
                counts.update((word, k) for word in set(words_of(text)) if len(word) <= 100)
            if len(counts) > 500_000:
                yield report()
        yield report()

    found = train.select(F.col("text").cast("binary"), "toxic", "half").mapInArrow(run, "word string, t0 long, o0 long, t1 long, o1 long")
    return found.groupBy("word").agg(*(F.sum(n).alias(n) for n in names[1:]))


def lexicon(counts: DataFrame, toxic: str, other: str, n_toxic: int, n_other: int) -> dict[str, float]:
    """Terms and weights (log-odds) from the counts in two columns."""
    c = F.col
    odds = F.log((c("t") + 0.5) / (n_toxic - c("t") + 0.5)) - F.log((c("o") + 0.5) / (n_other - c("o") + 0.5))
    found = counts.select("word", F.expr(toxic).alias("t"), F.expr(other).alias("o")).filter(c("t") >= LEAST_DOCS)
    found = found.withColumn("odds", odds).withColumn("z", c("odds") / F.sqrt(1 / (c("t") + 0.5) + 1 / (c("o") + 0.5))).filter((c("z") >= LEAST_Z) & (F.char_length("word") >= 3))
    rows = found.orderBy(F.desc("z"), "word").limit(TERMS).collect()
    return {term: SEED_WEIGHT for term in SEEDS} | {r["word"]: float(r["odds"]) for r in rows}


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (labels - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame, divisor: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels are learned only where crc32(id) modulo `divisor` isn't `held`."""
    c = F.col
    marks = marks_of(labels, divisor, held)
    copies = docs.select(c("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(7)).alias("copy")).join(marks, "doc_id")
    marks = copies.groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "copy", F.pmod("copy", F.lit(2)).cast("int").alias("half"))
    marks = cut(marks)

    def texts_of(chosen: DataFrame) -> DataFrame:
        """The chosen labelled rows with their texts; only those texts are shuffled (and a few whose ids share a bit)."""
        wanted = id_bitmap(chosen.select(c("doc_id").alias("id")))

        def pick():
            def work(ids: list, texts: list) -> dict:
                kept = [k for k, i in enumerate(ids) if in_bitmap(i, wanted)]
                return {"doc_id": [ids[k] for k in kept], "text": [texts[k] for k in kept]}

            return work

        return map_texts(docs, pick, "doc_id long, text binary").join(chosen, "doc_id")

    sizes = {(r["half"], r["toxic"]): r["n"] for r in marks.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    # words of a single harmless text teach nothing
    counts = cut(word_counts(texts_of(marks)).filter((c("t0") + c("t1") >= LEAST_DOCS) | (c("o0") + c("o1") >= 2)))
    size = lambda toxic, *halves: sum(sizes.get((h, toxic), 0) for h in halves)

    def matcher(toxic: str, other: str, *halves: int) -> Matcher:
        weights = lexicon(counts, toxic, other, size(1, *halves), size(0, *halves))
        bare = Matcher(weights)
        harmless = counts.select("word", F.expr(other).alias("o")).filter("o >= 1")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                chosen = [k for k, w in enumerate(part.column(0).to_pylist()) if (found := bare.find(w.encode())) and found[1]]
                yield part.take(pa.array(chosen, pa.int64()))

        common = harmless.mapInArrow(near, "word string, o long").orderBy(F.desc("o"), "word").limit(EXCEPTIONS).collect()
        return Matcher(weights, frozenset(r["word"] for r in common))

    half = matcher("t0", "o0", 0)
    most = size(0, 1) + size(1, 1)
    fitted = marks.filter("half = 1")
    if most > FIT_ROWS:
        fitted = fitted.filter(F.pmod("copy", F.lit(1_000_003)) < int(1_000_003 * FIT_ROWS / most))

    def measure() -> object:
        return lambda ids, texts: {"doc_id": ids, "x": [half.features(t) for t in texts]}

    rows = map_texts(texts_of(fitted), measure, "doc_id long, x array<double>").join(fitted.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").select("x", "toxic").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, 6)
    weights = logistic(x, np.array(rows.column("toxic").to_pylist(), float))
    full = matcher("t0 + t1", "o0 + o1", 0, 1)

    def step():
        def work(ids: list, texts: list) -> dict:
            found = np.array([full.features(t) for t in texts], float).reshape(-1, 6)
            return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))}

        return work

    found = map_texts(docs, step, "doc_id long, score double")
    return found.select("doc_id", (remainder(c("doc_id"), divisor) == held).alias("held_out"), "score", (c("score") >= threshold).cast("int").alias("predicted"))
