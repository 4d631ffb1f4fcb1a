"""Collocations and the prefix-free parse against brute force."""

import random
import re
from collections import Counter

import pytest

from sitefit.llm import collocations as module
from sitefit.llm.collocations import collocations, frequent_phrases, parse

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\f\r]", (text or "").translate(LOWER))]


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        inside = any(lang == other and len(longer) > len(words) and 100 * b >= 100 * a and any(longer[i : i + len(words)] == words for i in range(len(longer)))
                     for (other, longer), b in candidates.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, r + 1, *x[1:]) for r, x in enumerate(own)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma", "délta", "e", "z z", "日本", "the", "of", "a\x1cb"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(n))
    passage = some(90)
    rows = [(some(rng.randint(0, 120)), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [(some(rng.randint(0, 9)) + passage + some(rng.randint(0, 9)), "en") for _ in range(40)]
    rows += [(None, "en"), ("", None), (" \t\n", "de"), (",.;", "en"), ("same " * 5000, "fr"), (passage, "en"), (passage, "en"), ("lone", "it")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 1, 2, 3) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, words long, chunk long")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_equal_brute_force(spark, texts):
    assert listed(collocations(frame(spark, texts), least=20, top=50)) == brute(texts, 20, 50)
    assert listed(collocations(frame(spark, texts), least=3, top=7)) == brute(texts, 3, 7)


def test_small_buffers_and_a_full_bitmap_change_nothing(spark, texts, monkeypatch):
    for name, value in (("HELD", 64), ("CHUNK_BYTES", 256), ("SHARD", 100), ("FEW_LANGS", 0), ("ONE_IN", 3)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(module, "id_bitmap", _all_ones)
    assert listed(collocations(frame(spark, texts), least=20, top=50)) == brute(texts, 20, 50)


def _all_ones(ids):
    import numpy as np

    return np.full(module.BITS // 32 + 1, 0xFFFFFFFF, np.uint32)


def test_every_word_is_counted_once(spark, texts):
    known, totals = frequent_phrases(frame(spark, texts), least=1)
    f, n = counted(texts)
    assert {(r.lang, r.phrase): r.f for r in known.collect()} == {(lang, " ".join(p)): c for (lang, p), c in f.items()}
    assert {r.of: r.n for r in totals.collect()} == {lang: c for lang, c in n.items() if c}


def test_copied_passages_share_chunks(spark):
    passage = " ".join(f"w{i}" for i in range(600))
    rows = [(f"own{i} words{i} here {passage} end{i} of{i} it", "en") for i in range(30)]
    found = parse(frame(spark, rows)).agg({"n": "sum", "chunk": "count"}).first()
    assert found["count(chunk)"] < 0.4 * found["sum(n)"]


def test_no_rows(spark):
    assert listed(collocations(frame(spark, []))) == []
    assert listed(collocations(frame(spark, [(None, None), (" ", "en")]))) == []


def test_products_past_64_bits(spark):
    """Exact scores where 1000 * a * n has more than 19 digits are decimals; checked on the SQL expression itself."""
    row = spark.sql("SELECT (cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) AS s FROM VALUES (4000000000L, 9000000000000L, 5000000000L, 7000000001L) AS t(a, n, l, r)").first()
    assert row.s == 1000 * 4000000000 * 9000000000000 // (5000000000 * 7000000001)
