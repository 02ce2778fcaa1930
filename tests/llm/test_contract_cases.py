"""Cases of the operators' contracts that were wrong once."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import html_extract, langid, secrets, vectors


def test_letters_beside_digits_and_signs_have_a_language(spark):
    rows = [(i, ("the cat sat on the mat with m² " if i % 2 else "der hund liegt auf der matte ") * 4 + str(i), "en" if i % 2 else "de") for i in range(60)]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["m²", "10 km²", "x1y2", "½", "²", "1_000", "5€", "k9"]
    got = [r["lang_pred"] for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models).orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [not any(c.isalpha() for c in t) for t in texts]


def test_held_out_accuracy_and_repeated_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = langid.train(docs)
    found = langid.identify(docs.where("lang is not null"), models).where(langid.held_out(F.col("doc_id")) & (F.length("text") > 40))
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 30 and right >= 0.97 * n
    text = docs.where("lang is not null and length(text) > 100").first()["text"]
    twice = spark.createDataFrame([(1, text), (1, text), (2, (text + " ") * 2000)], "doc_id long, text string")
    got = langid.identify(twice, models).collect()
    assert len({r["lang_pred"] for r in got}) == 1 and got[0]["score"] == got[1]["score"]


def spans_by_hand(text):
    out = []
    for rank, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        for m in re.finditer(rule.pattern, text, re.I if rule.any_case else 0):
            if len(m[rule.group]) >= rule.min_chars:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def redacted(text, spans):
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_many_matches_of_one_text(spark):
    forge, jwt = "gho_" + "a1B2" * 10, "eyJhbGciOi.eyJzdWIiOiI.sig-na_ture"
    texts = ["é token=abcdef " * 900, f"{forge} x {jwt} " * 300 + "token=" + "0" * 40, "token=abcdef" * 600, f"password: {'deadbeef' * 4} AKIA{'A' * 20} " * 257, "none"]
    d = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in d.withColumn("safe", secrets.redact(F.col("text"), F.col("secret_spans"))).collect():
        spans = spans_by_hand(r["text"])
        assert [tuple(x) for x in r["secret_spans"]] == spans
        assert r["safe"] == redacted(r["text"], spans)


def test_scan_and_redaction_of_twenty_thousand_matches_end(spark):
    d = spark.createDataFrame([(1, "token=abcdef " * 20_000)], "doc_id long, text string")
    start = time.time()
    [r] = secrets.scan_secrets(d).select(F.size("secret_spans").alias("n"), secrets.redact(F.col("text"), F.col("secret_spans")).alias("safe")).collect()
    assert r["n"] == 20_000 and r["safe"] == "[SECRET] " * 20_000 and time.time() - start < 30


def test_long_keys_without_an_end_line_are_covered(spark):
    line = hashlib.sha256(b"x").hexdigest()
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join([line] * 3000)
    d = spark.createDataFrame([(1, f"my key {key}\nand plain words follow it")], "doc_id long, text string")
    [r] = secrets.scan_secrets(d).select(secrets.redact(F.col("text"), F.col("secret_spans")).alias("safe"), "secret_spans").collect()
    assert r["safe"] == "my key [SECRET]\nand plain words follow it"


def test_forge_tokens_have_trigrams():
    forge = next(r for r in secrets.MORE_RULES if r.kind == "forge")
    assert frozenset({"gho", "ho_"}) in secrets.trigram_query(forge.pattern)


@pytest.mark.parametrize("dim", [2, 4, 8, 15, 16, 32, 64, 256, 768])
def test_links_of_vectors_of_any_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((150, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((150, dim))
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate((base, 0.9305 * base + np.sqrt(1 - 0.9305**2) * noise))
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    more = [(None, rows[0][1], 1), (0, rows[0][1], 1), (900, rows[3][1], None)]
    got = vectors.near_vectors(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows) + len(more)
    cosine = x @ x.T
    want = (cosine >= 0.93) & ~np.eye(len(x), dtype=bool)
    found = sum(r["n_links"] for r in got if r["id"] not in (None, 0, 900))
    total = int(want[1:].sum()) + int(want[1:, 0].sum())  # the copy of row 0 counts as well
    assert 0.99 * total <= found <= total
    assert [(r["n_links"], r["component"], r["kept"]) for r in got if r["id"] is None] == [(0, None, False)]


ARTICLE = [f"Paragraph {k} tells a part of the story that nobody else tells, number {k * k}." for k in range(10)]


def read(spark, pages):
    d = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_main_text(d).orderBy("page_id").collect()]


@pytest.mark.parametrize("versions", [2, 3, 5, 12])
def test_versions_of_one_article_keep_every_character(spark, versions):
    texts = [[*ARTICLE[:k % 10], f"Corrected on day {k}.", *ARTICLE[k % 10 + 1 :]] for k in range(versions)]
    pages = [f"<body><nav>Menu</nav><article>{''.join(f'<p>{x}</p>' for x in t)}</article></body>" for t in texts]
    assert read(spark, pages) == ["\n".join(t) for t in texts]


def test_recipes_keep_their_sub_heads(spark):
    pages = [f"<body><article><h1>Dish {w}</h1><h2>Ingredients</h2><p>{w} flour, {w} eggs</p><h2>Method</h2><p>Stir {w} and bake {w}</p></article></body>" for w in ("one", "two", "three", "four", "five", "six", "seven")]
    got = read(spark, pages)
    assert all(t.split("\n")[1] == "Ingredients" and t.split("\n")[3] == "Method" and len(t.split("\n")) == 5 for t in got)


def test_reader_comments_in_articles_go():
    assert html_extract.extract("<article>one<article class=\"comment\">reply</article></article>") == "one"
    assert html_extract.extract("<article><p>one</p><ol class=commentlist><li>reply</li></ol></article>") == "one"


def test_the_wrapper_decides_where_names_say_nothing(spark):
    pages = [f"<body><article><h1>Head {w}</h1><p>story of {w} with words of its own</p><p>Our shop sells {w[0]}</p><div>Tell your friends</div></article></body>" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    without = [html_extract.extract(p) for p in pages]
    assert all(t.endswith("Tell your friends") for t in without)
    assert not any("Tell your friends" in t for t in read(spark, pages)) and all("story of" in t for t in read(spark, pages))
