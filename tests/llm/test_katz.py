"""Scores against a plain Katz model; probabilities of a context add up to one; odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from sitefit.llm import katz
from sitefit.llm.base import words_of


class Plain:
    def __init__(self, texts):
        self.uni, self.pairs, self.heads = Counter(), Counter(), Counter()
        for tokens in texts:
            self.uni.update(tokens)
            for h, w in zip([b"<s>", *tokens], tokens, strict=False):
                self.pairs[h, w] += 1
                self.heads[h] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.du, self.dp = katz.discounts(Counter(self.uni.values())), katz.discounts(Counter(self.pairs.values()))
        self.freed = sum((1 - d) * r * Counter(self.uni.values())[r] for r, d in self.du.items())
        after = defaultdict(list)
        for (h, w), c in self.pairs.items():
            after[h].append((w, c))
        self.alpha = {}
        for h, seen in after.items():
            kept = sum(self.dp.get(c, 1.0) * c for _, c in seen)
            grown = 1 if kept >= self.heads[h] else 0
            self.alpha[h] = ((1 - kept / (self.heads[h] + grown)) / (1 - sum(self.p1(w) for w, _ in seen)), grown)

    def p1(self, w):
        return self.du.get(self.uni[w], 1.0) * self.uni[w] / self.n if self.uni[w] else self.freed / self.n

    def p(self, h, w):
        c = self.pairs.get((h, w), 0)
        alpha, grown = self.alpha.get(h, (1.0, 0))
        return self.dp.get(c, 1.0) * c / (self.heads[h] + grown) if c else alpha * self.p1(w)


@pytest.mark.parametrize("small_tables", [False, True])
def test_equals_plain_model(small, monkeypatch, small_tables):
    if small_tables:  # rare words by joins, spread contexts, many blocks and shards
        for name, value in (("HOT", 400), ("SPREAD", 15), ("BLOCK_TOKENS", 3000), ("PAIR_TOKENS", 3000), ("SHARD_TOKENS", 5000)):
            monkeypatch.setattr(katz, name, value)
    docs, _ = small
    texts = {r["doc_id"]: [*words_of(r["text"].encode()), b"</s>"] for r in docs.collect()}
    model = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    found = {r["doc_id"]: r for r in katz.katz_scores(docs).collect()}
    assert found.keys() == texts.keys()
    for i, tokens in texts.items():
        r = found[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(model.uni[w] > 0 for w in tokens), model.n)
        assert math.isclose(r["base_score"], sum(math.log10((model.uni[w] + 1) / (model.n + model.v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(model.p(h, w)) for h, w in zip([b"<s>", *tokens], tokens, strict=False)), rel_tol=1e-7)
    # a context's probabilities, the unknown word's among them, add up to one
    for h in [b"<s>", *list(model.uni)[:5]]:
        assert math.isclose(sum(model.p(h, w) for w in [*model.uni, b"never seen"]), 1.0, rel_tol=1e-9)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(odd_docs, no_docs):
    found = {r["doc_id"]: r for r in katz.katz_scores(odd_docs).collect()}
    assert None not in found and found[1]["n_tokens"] == found[2]["n_tokens"] == 1 and found[7]["n_tokens"] == 2 * found[6]["n_tokens"]
    assert all(math.isfinite(r["score"]) for r in found.values())
    assert katz.katz_scores(no_docs).count() == 0
