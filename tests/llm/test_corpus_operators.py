"""Operators that hold documents against each other, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import decontaminate, embedding_dedup, line_dedup, lm, ngram_join, queries, suffix_dedup
from tarmac.llm.components import components

from .test_text_operators import odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_jaccard(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    parent = {i: i for i in texts}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in texts}


def near_copies(rng, groups=6, size=7):
    """Groups of texts a few words apart, chains included, sizes from 5 to 400 words."""
    texts = []
    for _ in range(groups):
        base = prose(rng, rng.choice([5, 9, 12, 20, 40, 100, 400])).split()
        for _ in range(size):
            if rng.random() < 0.7:
                base = list(base)
                for _ in range(max(1, len(base) // rng.choice([20, 40, 100]))):
                    base[rng.randrange(len(base))] = prose(rng, 1)
            texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = near_copies(rng) + ["", None, "One", "one", "two words", "a b c", "A  b\tC", *(prose(rng, 30) for _ in range(20))]
    rng.shuffle(texts)
    docs = odd(spark, list(enumerate(texts))).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n, percent).collect()}
    assert got == brute_jaccard(dict(enumerate(texts)), n, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_file(percent):
    """The pigeonhole bound: every linked pair of random sets is filed together at least once."""
    rng, rule = np.random.default_rng(percent), ngram_join.Rule(percent)
    for _ in range(400):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        y = set(x.tolist())
        while True:
            z = set(y)
            if rng.random() < 0.5 and len(z) > 1:
                z.remove(sorted(z)[int(rng.integers(len(z)))])
            else:
                z.add(int(rng.integers(0, 1 << 63)) * 2 + 1)
            if 100 * len(z & set(x.tolist())) < percent * len(z | set(x.tolist())):
                break
            y = z
        y = np.sort(np.array(list(y), np.uint64))
        row, found, needs = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), rule)
        shared = collections.Counter(f & ngram_join.CROWDED for f in set(found[row == 0].tolist()) & set(found[row == 1].tolist()))
        least = [{level: k for r, level, k in needs.tolist() if r == side} for side in (0, 1)]
        assert any(all(n >= need.get(level, 1 << 30) for need in least) for level, n in shared.items())


def test_jaccard_odd_tables(spark):
    assert ngram_join.jaccard_components(odd(spark, [])).count() == 0
    text = prose(random.Random(1), 30)
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, "")]
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.jaccard_components(odd(spark, rows)).collect())
    assert got == [(-1, None), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8)]
    kept = ngram_join.one_of_each(odd(spark, rows))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 3, 7, 8] and kept.columns == odd(spark, rows).columns


def test_repeated_rows_with_near_copies(spark):
    """A repeated row neither loses its links nor gains any: copies above the threshold and below it."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(202)]

    def changed(places):
        return " ".join(f"x{k}" if k in places else w for k, w in enumerate(base))

    texts = {1: " ".join(base), 2: changed({50, 150}), 3: changed({20, 60, 100, 140, 180}), 4: changed({30, 70, 110, 150, 190}), 5: changed({51}), 6: prose(rng, 100)}
    rows = [(i, t) for i, t in texts.items() for _ in range(2)]
    expected = brute_jaccard(texts, 3, 90)
    assert expected[2][1] == expected[5][1] == 1 and expected[3][1] == 3 and expected[4][1] == 4
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd(spark, rows), 3, 90).collect())
    assert got == sorted((i, *expected[i]) for i, _ in rows)


def test_null_ids_before_equal_texts(spark):
    """A row without an id doesn't stand for its class."""
    text = prose(random.Random(5), 80).split()
    near = " ".join([*text[:40], "odd", *text[41:]])
    for rows in ([(None, " ".join(text)), (1, " ".join(text)), (2, near)], [(1, " ".join(text)), (2, near), (None, " ".join(text))]):
        got = ngram_join.jaccard_components(odd(spark, rows).coalesce(1), 3, 90).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1)]


def test_a_large_group_of_near_copies(spark):
    """Independent edits of one text around the threshold: no link is lost, whoever the hub is."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = {}
    for i in range(1200):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            words[at] = prose(rng, 1)
        texts[i] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd(spark, list(texts.items())), 3, 90).collect()}
    expected = brute_jaccard(texts, 3, 90)
    assert len({c for _, c in expected.values()}) > 50 and got == expected


def test_shingles_of_few_words(spark):
    """A whole step of fewer words than an n-gram has, down to none."""
    for k in range(6):
        got = ngram_join.jaccard_components(odd(spark, [(7, prose(random.Random(k), k))]), 5, 80).collect()
        assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(7, min(k, 1), 7)]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for link in links for x in link}
    for a, b in links:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(parent, i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts):
    width = suffix_dedup.WINDOW
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("run", [16_000, 4])
def test_repeats_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rng = random.Random(4)
    base = ["".join(rng.choice("ab") for _ in range(2000)) for _ in range(3)]
    texts = []
    for _ in range(120):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 500)))
        for _ in range(rng.randint(0, 3)):
            b, x = rng.choice(base), rng.randint(0, 1900)
            t += b[x : x + rng.randint(50, 400)] + rng.choice(["", "z", "é"])
        texts.append(t)
    texts += [None, "", "a" * 700, "xy" * 300, "q" * 199, "q" * 200, "r" * 201, texts[0], texts[5]]
    ids = list(range(len(texts) - 2)) + [None, 5]
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(odd(spark, list(zip(ids, texts, strict=True))).repartition(3)).collect())
    assert got == collections.Counter((i, *x) for i, x in zip(ids, brute_repeats(texts), strict=True))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(odd(spark, [])).count() == 0


def test_multikey_runs():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (200, 4))
    order, run = suffix_dedup.multikey_runs(words)
    rows = [tuple(w) for w in words[order]]
    assert rows == sorted(rows) and [a == b for a, b in zip(rows, rows[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def test_lines_against_sql(spark):
    rng = random.Random(8)
    passages = [[prose(rng, 6) for _ in range(rng.randint(2, 12))] for _ in range(5)]
    rows = []
    for i in range(60):
        lines = [prose(rng, 5) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            lines += rng.choice(passages) + [prose(rng, 4)] * rng.randint(0, 2)
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (63, rows[3][1]), (64, "a\nb\n" * 2000)]
    docs = odd(spark, rows)
    got = line_dedup.dedup_lines(docs.withColumn("__gone", F.lit(1)))
    assert [c for c in got.columns if c in ("lang", "size", "score")] == ["lang", "score", "size"] and got.where("text is null").count() == 1
    got = got.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(line_dedup.ORACLE).fetchall())
    assert got.agg(F.sum("n_removed_lines")).first()[0] > 50


def test_lines_odd_tables(spark):
    assert line_dedup.dedup_lines(odd(spark, [])).count() == 0
    text = "\n".join(prose(random.Random(3), 5) for _ in range(20))
    got = line_dedup.dedup_lines(odd(spark, [(2, text), (1, text), (1, text), (None, text)])).collect()
    assert sorted((r.doc_id or 9, r.n_removed_lines > 0) for r in got) == [(1, False), (1, False), (2, True), (9, True)]


@pytest.mark.parametrize("shared", [5, None])
def test_lines_of_equal_ids(spark, shared):
    """Rows of one id, or of none, keep their own places: what occurs once stays."""
    rng = random.Random(4)
    a, b = ("\n".join(prose(rng, 5) for _ in range(15)) for _ in range(2))
    got = line_dedup.dedup_lines(odd(spark, [(1, a), (shared, a), (shared, b)])).collect()
    assert sorted((r.doc_id or 9, r.n_lines, r.n_removed_lines, r.text) for r in got) == sorted([(1, 15, 0, a), (shared or 9, 15, 15, ""), (shared or 9, 15, 0, b)])
    # Equal ids and places: one of them leads.
    got = line_dedup.dedup_lines(odd(spark, [(shared, a + "\n" + b), (shared, a + "\nx\n" + b + "\ny")])).collect()
    assert sum(r.n_removed_chunks > 0 for r in got) == 1


def test_share_of_planted_blocks(spark):
    """Copies go whole, paragraphs set off by empty lines too; blocks amid unlike text go for the share that the rule gives."""
    rng = random.Random(6)
    for gap in ("\n", "\n\n"):
        texts = [gap.join(prose(rng, 8) for _ in range(n)) for n in range(2, 12)]
        got = line_dedup.dedup_lines(odd(spark, list(enumerate(texts * 2)))).collect()
        assert all(r.text == (texts[r.doc_id] if r.doc_id < 10 else "") for r in got)
    for size, least in ((5, 0.1), (10, 0.4), (20, 0.65)):
        rows, block = [], []
        for k in range(60):
            block = block if k % 2 else [prose(rng, 8) for _ in range(size)]
            rows.append((k, "\n".join([prose(rng, 8) for _ in range(rng.randint(6, 12))] + block + [prose(rng, 8) for _ in range(rng.randint(6, 12))])))
        gone = {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(odd(spark, rows)).collect()}
        assert sum(v for k, v in gone.items() if k % 2 == 0) == 0 and least * size * 30 <= sum(gone.values()) <= size * 30, (size, sum(gone.values()))


def planted(rng, item, kind):
    words = item.split()
    if kind == "edited":
        words = [prose(rng, 1) if rng.random() < 0.15 else w for w in words]
    if kind == "cased":
        words = [w.upper() + "," for w in words]
    if kind == "gaps":
        words = [x for w in words for x in ([w, prose(rng, 1)] if rng.random() < 0.15 else [w])]
    return " ".join(words)


def test_contamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (18, 30, 45, 60, 900)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "ba be"), (4, items[4])], "item_id long, text string").withColumn("score", F.lit("clash"))
    rows, expected = [], set()
    for k, item in enumerate(items):
        for kind in ("exact", "edited", "cased", "gaps"):
            rows.append((len(rows), f"{prose(rng, 50)} {planted(rng, item, kind)}\n{prose(rng, 50)}"))
            expected.add((len(rows) - 1, k))
    clean = [(1000 + i, prose(rng, 200)) for i in range(30)] + [(2000, None), (2001, ""), (2002, " ".join(items[0].split()[:4]))]
    docs = odd(spark, rows + clean)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and all(0.5 <= r.score <= 1 for r in got)
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in clean) and kept.columns == docs.columns
    assert decontaminate.contaminated(odd(spark, []), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_contamination_against_all_pairs(spark, sf_dir):
    """Every document against every item by plain alignment of words: the same pairs."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    number: dict = collections.defaultdict(lambda: len(number))
    as_array = lambda t: np.array([number[w] for w in words(t)], np.int64)
    texts, expected = {i: as_array(t) for i, t in docs.items()}, set()
    for k, t in items.items():
        item = as_array(t)
        for i, text in texts.items():
            # An alignment needs more of the item's words in the text than a quarter of a whole copy's.
            if np.isin(text, item).sum() * decontaminate.MATCH < decontaminate.LEAST_SCORE * decontaminate.MATCH * min(len(item), decontaminate.WHOLE_WORDS):
                continue
            best = decontaminate.align(item, text)[0] if len(text) else 0
            if best >= decontaminate.LEAST_SCORE * decontaminate.MATCH * min(len(item), decontaminate.WHOLE_WORDS):
                expected.add((i, k))
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf_dir).collect()}
    assert got == expected and got


def test_copies_found_often(spark):
    """An edited and a partial copy of an item stay found however many documents hold them."""
    rng = random.Random(11)
    items = [prose(rng, 64) for _ in range(2)]
    edited = items[0].split()
    for k in (9, 25, 41, 57):
        edited[k] = "changed"
    copies = [" ".join(edited), " ".join(items[1].split()[:42])]
    rows = [(k, f"{prose(rng, 40)} {copies[k % 2]} {prose(rng, 40)}") for k in range(200)]
    common = " ".join(items[0].split()[:6])
    rows += [(1000 + k, f"{prose(rng, 100)} {common} {prose(rng, 100)}") for k in range(50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(odd(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k % 2) for k in range(200)}
    assert {r.doc_id for r in decontaminate.clean(odd(spark, rows), bench).collect()} == {1000 + k for k in range(50)}


def test_bounds_of_alignments():
    """No alignment scores more than the bound by which it is passed over."""
    rng = np.random.default_rng(12)
    items = decontaminate.Items([0, 1, 2], [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in (5, 20, 40)])
    text, _, _, _ = decontaminate.tokens(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 60, 400))], pa.large_string()))
    begin = rng.integers(0, 399, 300)
    end, item = np.minimum(400, begin + rng.integers(1, 80, 300)), rng.integers(0, 3, 300)
    for k, a, b, bound in zip(item, begin, end, items.bounds(item, text, begin, end), strict=True):
        score = decontaminate.align(items.words[items.first[k] : items.first[k + 1]], text[a:b])[0]
        assert score <= max(bound, 0) and (bound > 0) == (score > 0)


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(7)
    items = [prose(rng, 40) for _ in range(6)]
    docs = odd(spark, [(k, prose(rng, 20) + " " + x) for k, x in enumerate(items)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(6)}


def smith_waterman(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_model_scores(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) + [None] for r in docs}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i, ws in words.items() if i not in held for w in ws)
    total, known = sum(counts.values()), len(counts)
    got = queries.op3_pitman_yor_scores(spark, sf_dir).collect()
    assert len(got) == len(words)
    for r in got:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + known + 1)) for x in w), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(w)), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    scored = spark.createDataFrame([(r.held_out, r.n_tokens, r.base_score, r.score) for r in got], "held_out boolean, n_tokens long, base_score double, score double")
    assert lm.held_out_perplexity(scored) < lm.held_out_perplexity(scored, "base_score")


def test_frequent_words_of_any_batches(spark, monkeypatch):
    """The same triggers however texts are cut: those of the counts over all."""
    monkeypatch.setattr(lm, "TRIGGERS", 8)
    monkeypatch.setattr(lm, "SHARE", 40)
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choices(words[k % 3 * 20 :], weights=range(1, 61 - k % 3 * 20), k=80)) for k in range(90)]
    counts = collections.Counter(w for t in texts for w in t.split())
    total = sum(counts.values())
    some = {w: n for w, n in counts.items() if n * 40 >= total}
    least = sorted(some.values(), reverse=True)[:8][-1]
    found = [set(lm.frequent(odd(spark, list(enumerate(texts))).repartition(k)).tolist()) for k in (1, 7)]
    hashed = lambda w: int(lm.tokens(pa.array([w], pa.large_string()))[0][0])
    assert found[0] == found[1] and len(found[0]) == min(8, len(some))
    assert {hashed(w) for w, n in some.items() if n > least} <= found[0] <= {hashed(w) for w, n in some.items() if n >= least}


def test_gathered_words_are_summed(spark, monkeypatch):
    """A task that meets the same words again and again holds, and hands on, one row for each of them."""
    monkeypatch.setattr(lm, "GATHER", 100)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(30)], k=40)) for _ in range(50)]
    docs = spark.createDataFrame([(t, 1, True) for t in texts], "text string, block long, learn boolean").coalesce(1)
    contexts = lm.Contexts(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = lm.occurrences(docs, contexts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({r.w for r in got}) == 31
    assert sum(r.c0 for r in got) == 50 * 41


def test_probabilities_sum_to_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.where(rng.random((300, lm.GROUPS)) < 0.4, rng.geometric(0.3, (300, lm.GROUPS)), 0)
    counts[0] = 5000
    counts = counts[counts.sum(1) > 0]
    frame = spark.createDataFrame([(int(k * 977), *map(int, c)) for k, c in enumerate(counts)], "w long, " + ", ".join(f"c{g} long" for g in range(lm.GROUPS))).coalesce(2)
    model, total = lm.fit(frame)
    assert total == counts.sum()
    backoff = np.array([model.backoff(t) for t in model.totals[lm.BURN_IN :]]) / lm.SAMPLES
    mass = np.array([model.parent(np.zeros(1), np.zeros(1), t)[0] for t in model.totals[lm.BURN_IN :]]) @ backoff
    for r in lm.probabilities(frame, model).collect():
        own = np.array(r.p) @ backoff
        own[list(r.g)] = r.q
        mass = mass + own
    assert mass == pytest.approx(np.ones(lm.GROUPS), rel=2e-3)


def test_tables_of_a_dish():
    """Drawn table numbers follow their conditional: S(c, t) rate^t over its sum."""
    table, n = lm.stirling(0.5), 4000
    word = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = lm.seat(np.full(n, 6), np.full(n, 0.8), 0.5, table, word, np.zeros(n, int), 0)
    weights = np.exp(table[6] + np.arange(lm.EXACT + 1) * math.log(0.8))
    expected = (weights / weights.sum())[:7]
    assert np.abs(np.bincount(drawn.astype(int), minlength=7) / n - expected).max() < 0.03
    assert (lm.seat(np.array([0, 1, 500]), np.full(3, 2.0), 0.5, table, word[:3], np.zeros(3, int), 0) >= [0, 1, 1]).all()


def test_model_odd_tables(spark):
    assert lm.scores(odd(spark, []), F.lit(True)).count() == 0
    rows = [(1, None), (1, None), (2, ""), (None, "b a"), (3, "a b " * 3000)]
    got = lm.scores(odd(spark, rows), F.col("doc_id") == 3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out) for r in got) == [(0, 3, 3, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, True), (3, 6001, 6001, False)]
    assert all(r.score == r.base_score == 0 for r in lm.scores(odd(spark, rows), F.lit(False)).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0))


def brute_vectors(rows):
    out, parent = collections.Counter(), {}
    sound = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows}
    for k, (i, v, g) in enumerate(sound):
        for j, w, h in sound[k + 1 :]:
            if g == h and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                out[i] += 1
                out[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (out[i], find(parent, i)) for i, _, _ in rows}


@pytest.mark.parametrize("dim", [64, 8])
def test_vectors_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 12)):
            v = base + rng.standard_normal(dim) * rng.choice([0.0, 0.08, 0.13, 0.2])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * dim, 0), (n + 3, [float("nan")] * dim, 0), (n + 4, rows[0][1], None), (n + 5, [None, 1.0], 0), (n + 6, [float("inf")] * dim, 0), (n + 7, rows[0][1][: dim // 2], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_links(vectors(spark, rows)).collect()}
    expected = brute_vectors(rows)
    assert sum(a[0] for a in got.values()) >= 0.99 * sum(a[0] for a in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in got) and sum(got[i] == expected[i] for i in got) >= 0.98 * len(rows)
    assert all(got[i] == (0, i) for i in range(n, n + 7))


def test_vectors_odd_tables(spark):
    assert embedding_dedup.near_links(vectors(spark, [])).count() == 0
    got = embedding_dedup.near_links(vectors(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_vectors_of_equal_ids(spark):
    """Unequal vectors of one id, under two labels and under one, are vectors of their own."""
    rng = np.random.default_rng(3)
    x, far = rng.standard_normal(32), rng.standard_normal(32)
    near = [(x + 0.02 * rng.standard_normal(32)).tolist() for _ in range(3)]
    rows = [(5, near[0], 0), (5, near[1], 1), (9, near[2], 0), (9, far.tolist(), 0)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_links(vectors(spark, rows)).collect()]
    assert sorted(got) == [(5, 0, 5), (5, 1, 5), (9, 0, 9), (9, 1, 5)]
