"""Lexical search, token counts and whitening against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from barloom.llm import lexical_search, token_counts, whitening
from barloom.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, score long, item_id long"
PATH = tokenizer_path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items):
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in held:
            tf, m = Counter(t), 25 + (75 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms(text) if x in tf)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:10])]
    return Counter(out)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "Σx", "A1", "日本"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(64)], k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!?."), (None, "w3 w4 w5"), (3, docs[3][1]), (503, "w59-W59_w59 " * 20_000)] + [(600 + k, "w1 w2 w40") for k in range(200)]
    items = [(0, "w1 w2 w3 W3"), (1, "w59 Ünder ünder"), (2, None), (3, "???"), (4, "nowhere"), (None, "w40 w2"), (4, "日本 σx Σx"), (5, " ".join(words))]
    frame = spark.createDataFrame([(i, t, 7, 8) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, rank int")
    for batch in (1_000_000, 60):
        got = lexical_search.rank_documents(frame, asked, batch_chars=batch)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_ranks(docs, items)
    assert lexical_search.rank_documents(frame.limit(0), asked).count() == 0 == lexical_search.rank_documents(frame, asked.limit(0)).count()


def test_balls_bound_every_inner_product_and_prune():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((900, 40)) < 0.1, rng.integers(1, 1_000_000, (900, 40)), 0)
    x[100:300] = x[100]  # copies
    tree = lexical_search.BallTree(x.astype(float), leaf_rows=16)
    q = np.where(rng.random((30, 40)) < 0.2, rng.integers(0, 9000, (30, 40)), 0)
    exact, bounds = q @ x.T, tree.bounds(q.astype(float))
    for k, (rows, children) in enumerate(tree.nodes):
        assert (exact[:, rows].max(axis=1) <= bounds[:, k]).all()
        assert not children or sorted(np.concatenate([tree.nodes[c][0] for c in children])) == sorted(rows)
    items = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in q]
    ranks = [lexical_search.Ranking(10) for _ in items]
    ids = rng.permutation(900)
    scored = lexical_search.search(tree, x, ids, np.zeros(900, bool), items, ranks, bounds)
    assert scored < 0.9 * 900 * len(items)
    for k, r in enumerate(ranks):
        want = sorted((-int(s), int(i)) for s, i in zip(exact[k], ids) if s > 0)[:10]
        assert [(s, i) for s, _, i in r.rows] == want


def counted(texts):
    tok = Tokenizer.from_file(PATH)
    return {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in texts}


def test_counts_equal_the_library(spark):
    rng = random.Random(8)
    signs = ["'s", "don't", "  ", "\n", "\n\n \t", "é", "日本語。", "한국", "🙂", "12345", "<|endoftext|>", "x-y_z", "don 't", "　", "​", "a" * 40, "\x1c", "word", "Wörter"]
    texts = [(k, "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randint(0, 500)))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, "a" * 3000), (203, " " * 2500), (204, "<|endoftext|>" * 200), (205, "日本" * 900), (206, "?" * 1500 + "ab" * 800)]
    rows = [(i, t, 0, 0) for i, t in texts] + [(7, texts[7][1], 0, 0), (None, texts[9][1], 0, 0)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), PATH, core=300, overlap=24).collect()
    want = counted(texts)
    want[None] = want[9]
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == want[r["id"]], r["id"]
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_splices_are_ends_of_tokens_in_any_context():
    tok, counter = Tokenizer.from_file(PATH), token_counts.Counter(PATH)
    rng = random.Random(2)
    alphabet = "ab Z'\"s1 9.,-\n\t<|>é日。！ 한 "
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=60)) + rng.choice(["", "<|endoftext|>"]) + "".join(rng.choices(alphabet, k=20))
        total, (marks,) = counter.window(text, [(0, len(text))])
        for at, before in marks:
            a, b = (len(tok.encode(x, add_special_tokens=False)) for x in (text[:at], text[at:]))
            assert (a, a + b) == (before, total), (text, at)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(tokenizer_path("word_bpe_49k.json"))


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for rows, dim, top in ((1, 1, 1), (65, 3, 4000), (200, 5, 2**45), (64, 4, 1)):
        x = rng.integers(-top, top, (rows, dim)) + 100_000
        s, q = whitening.scatter(x)
        assert s == [sum(int(v) for v in x[:, i]) for i in range(dim)]
        assert q == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(i, dim)] for i in range(dim)]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 10)) * np.arange(1, 11) / 20
    rows = [(k, [float(np.float32(c)) for c in v], 0, 0.0) for k, v in enumerate(base)]
    bad = [(900, None, 0, 0.0), (901, [1.0] * 9 + [float("nan")], 0, 0.0), (902, [1.0] * 9 + [float("inf")], 0, 0.0), (903, [None] * 10, 0, 0.0), (904, [], 0, 0.0), (905, [1e30] * 10, 0, 0.0)]
    more = [(5, rows[5][1], 0, 0.0), (None, rows[6][1], 0, 0.0)]
    frame = spark.createDataFrame(rows + bad + more, "vec_id long, embedding array<float>, component int, whitened double")
    got = whitening.whiten(frame).collect()
    used = [r for r in rows + more]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _, _ in used]
    n, s = len(x), [sum(c) for c in zip(*x)]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    cov = np.array([[float(Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in x), n**3)) for j in range(10)] for i in range(10)])
    values, vectors = np.linalg.eigh(cov)
    off = np.array([[n * c - t for c, t in zip(a, s)] for a in x])
    for r in got:
        k = next(i for i, u in enumerate(used) if u[0] == r["id"])
        c = r["component"]
        assert r["deviation"] == int(r["deviation_digits"]) == sum(int(v) ** 2 for v in off[k])
        assert abs(r["explained"] - values[-c] / cov.trace()) < 1e-9 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(off[k] / n @ vectors[:, -c]) / math.sqrt(values[-c])) < 1e-7
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.where("vec_id = 3")).collect()
    assert len(one) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in one)


def test_lengths_have_models_of_their_own_and_large_numbers_stay_exact(spark):
    rows = [(k, [float(k % 7) * 5e14, float(k)]) for k in range(50)] + [(100 + k, [float(k * k)]) for k in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["id"] >= 100, r["n"], r["component"]) for r in got} == {(False, 50, 1), (False, 50, 2), (True, 20, 1)}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows[:50]]
    s = [sum(c) for c in zip(*x)]
    exact = {k: sum((50 * c - t) ** 2 for c, t in zip(v, s)) for k, v in enumerate(x)}
    for r in got:
        if r["id"] < 100:
            assert int(r["deviation_digits"]) == exact[r["id"]]
            assert r["deviation"] == (exact[r["id"]] if exact[r["id"]] < 2**63 else None)
