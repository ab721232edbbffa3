"""The Pitman-Yor model with a restaurant for each preceding word, against a plain computation in one place."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import bigram, lm
from tarmac.llm.common import in_fold

from .test_corpus_operators import prose
from .test_text_operators import odd


def hashes(text):
    return [int(x) for x in lm.tokens(pa.array([text or ""], pa.large_string()))[0]]


def plain(texts, learn):
    """log10 probability of each text, by dictionaries; and a model's probabilities of each known word and an unknown one."""
    begin = int(bigram.BEGIN)
    words = {i: hashes(t) for i, t in texts.items()}
    pairs = collections.Counter(p for i, w in words.items() if i in learn for p in zip([begin, *w[:-1]], w, strict=True))
    known = sorted({w for _, w in pairs})
    share = lambda found: min(max(found[1] / max(found[1] + 2 * found[2], 1), 0.1), 0.95)
    discount = share(collections.Counter(pairs.values()))

    def totals(of, k):
        out = collections.Counter()
        for p, n in of.items():
            out[p[k]] += n
        return out

    tables = dict.fromkeys(pairs, 1)
    customers, seated, top = totals(pairs, 0), totals(tables, 1), dict.fromkeys(known, 1)
    parent_discount = share(collections.Counter(seated.values()))

    def chance(here, there, seated, top):
        new = (lm.STRENGTH + parent_discount * sum(top.values())) / (len(known) + 1)
        return (here - parent_discount * there + new) / (lm.STRENGTH + sum(seated.values()))

    def drawn(c, rate, discount, word, place, sweep):
        one = lambda x, t: np.array([x], t)
        return int(lm.seat(one(c, np.int64), one(rate, float), discount, lm.stirling(discount), one(word, np.uint64), one(place, np.uint64), sweep)[0])

    models = []
    for sweep in range(1, lm.BURN_IN + lm.SAMPLES + 1):
        own = totals(tables, 0)
        fresh = {}
        for (u, w), c in pairs.items():
            others = seated[w] - tables[u, w]
            rate = (lm.STRENGTH + discount * (own[u] - tables[u, w])) * chance(others, min(top[w], others), seated, top)
            fresh[u, w] = drawn(c, rate, discount, w, u, sweep) if c > 1 else 1
        rate = (lm.STRENGTH + parent_discount * sum(top.values())) / (len(known) + 1)
        tables, seated = fresh, totals(fresh, 1)
        top = {w: drawn(seated[w], rate, parent_discount, w, 0, sweep) for w in known}
        if sweep > lm.BURN_IN:
            models.append((tables, totals(tables, 0), seated, top))

    def probability(u, w):
        out = 0.0
        for tables, own, seated, top in models:
            p = chance(seated[w], top.get(w, 0), seated, top)
            out += (pairs[u, w] - discount * tables.get((u, w), 0) + (lm.STRENGTH + discount * own[u]) * p) / (lm.STRENGTH + customers[u])
        return out / len(models)

    for u in [begin, *known[:5], 12345]:
        assert sum(probability(u, w) for w in [*known, 54321]) == pytest.approx(1)
    return {i: sum(math.log10(probability(u, w)) for u, w in zip([begin, *w[:-1]], w, strict=True)) for i, w in words.items()}


@pytest.mark.parametrize("block,size", [(2_000_000, 1 << 24), (150, 1 << 24), (400, 300), (1, 900)])
def test_scores_of_any_blocks_and_buckets(spark, monkeypatch, block, size):
    monkeypatch.setattr(bigram, "BLOCK", block)
    monkeypatch.setattr(bigram, "BUCKET_BYTES", size)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "of", "a b", *(prose(rng, 1) for _ in range(3))], k=rng.randrange(1, 60))) for _ in range(60)]
    texts = dict(enumerate([*texts, None, "", "of the of the " * 40, "The\tOF", "never seen"]))
    learn = {i for i in texts if i % 5 and i < 64}
    got = bigram.scores(odd(spark, list(texts.items())).repartition(2), (F.col("doc_id") % 5 != 0) & (F.col("doc_id") < 64)).collect()
    expected = plain(texts, learn)
    assert {r.doc_id for r in got if not r.held_out} == learn and len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-5)


def test_each_preceding_word_is_a_context(spark):
    """Not only frequent words: every one of 300 words is followed by its own."""
    rng = random.Random(6)
    lines = [" ".join(f"first{k} second{k}" for k in rng.sample(range(300), 20)) for _ in range(90)]
    asked = [(1000 * (shift + 1) + k, f"first{k} second{(k + shift) % 300}") for k in range(300) for shift in (0, 1)]
    got = {r.doc_id: r.score for r in lm.scores(odd(spark, [*enumerate(lines), *asked]), F.col("doc_id") < 1000).collect()}
    seen = {int(w[5:]) for t in lines for w in t.split() if w.startswith("first")}
    assert len(seen) > 290 and all(got[1000 + k] - got[2000 + k] > 1 for k in seen)


def test_below_the_perplexity_of_triggers(spark, sf_dir):
    docs, learn = spark.read.parquet(f"{sf_dir}/documents.parquet"), ~in_fold("doc_id", 7, 2)
    found = [lm.held_out_perplexity(f(docs, learn)) for f in (lm.scores, lm.trigger_scores)]
    assert found[0] < 0.9 * found[1]


def test_common_restaurants_are_spread():
    """What follows the commonest word doesn't lie in one bucket, and answers in order find their pairs again."""
    words, size = np.array(hashes(" ".join(f"the w{k}" for k in range(2000))), np.uint64), 8
    spread = np.sort(np.array([hashes("the")[0], bigram.BEGIN], np.uint64))
    found = list(bigram.block_rows(-1, pa.array([7]), np.array([True]), words, np.array([0, len(words)]), size, spread))
    most = [len(bigram.read_pairs(pa.py_buffer(r[4]))[3]) for r in found if r[1] == bigram.PAIRS]
    assert sum(most) == len({*zip(words, words[1:]), (0, words[0])}) and max(most) < 0.25 * sum(most)
