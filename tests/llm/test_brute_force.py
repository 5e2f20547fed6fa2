"""Queries without SQL against plain versions, over whole tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, html, langid, pii, queries, toxicity

DATA = str(oracle.DATA)
MASK = (1 << 64) - 1


def rows(spark, name, folder=DATA):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


# main text


class Article(HTMLParser):
    """Block texts of the article element, by the standard library's parser."""

    BREAKS = html.BLOCK | {"hr"}

    def __init__(self):
        super().__init__()
        self.inside, self.raw, self.parts, self.blocks = 0, 0, [], []

    def end_block(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.inside and tag in self.BREAKS:
            self.end_block()
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.inside and tag in self.BREAKS:
            self.end_block()
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.parts.append(data)


def test_main_text_is_the_article_of_all_pages(spark):
    got = {r["page_id"]: r for r in queries.op5_html_extraction(spark, DATA).collect()}
    pages = rows(spark, "pages")
    assert len(got) == len(pages) > 20
    for page in pages:
        plain = Article()
        plain.feed(page["html"] or "")
        assert got[page["page_id"]]["text"] == "\n".join(plain.blocks) and got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])


@pytest.mark.parametrize("tag", ["select", "svg", "object", "noscript", "math", "textarea", "canvas", "template"])
def test_elements_without_an_end_hide_nothing(tag):
    texts = ["First paragraph", "second", "third"]
    assert html.leaf_blocks(f"<div><p>First paragraph <{tag}><p>second</p></div><p>third</p>").text == texts
    closed = html.leaf_blocks(f"<div><p>First paragraph <{tag}>x</{tag}></p><p>second</p></div><p>third</p>").text
    assert closed == (["First paragraph x", *texts[1:]] if tag == "math" else texts)
    assert html.leaf_blocks(f"<p>First paragraph <{tag}><p>second</p><p>third</p><{tag}>x</{tag}>").text[1:3] == texts[1:]


def test_long_blocks_are_looked_at_whole():
    text = "word " * 200
    one, two = (html.features([html.leaf_blocks(f"<p>{t}</p>")])[0] for t in (text, text + "© 2020, all rights reserved |"))
    assert (one != two).sum() >= 3


def test_pages_with_clashing_columns_and_repeats(spark):
    page = "<article><h1>A title of some words</h1>" + "<p>One more sentence of the story, and another one. It goes on.</p>" * 4000 + "</article><footer>menu</footer>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", "<p>x")], "page_id long, url string, html string")
    for name in ("text", "n_chars", "own", "label"):
        df = df.withColumn(name, F.lit("clash"))
    got = html.extract_main_text(df).collect()
    assert [r["n_chars"] for r in got if r["page_id"] == 1] == [len("A title of some words") + 4000 * 61] * 2 and len(got) == 3


# language


def buckets(text):
    """Numbers of the hashed n-grams of a text, one character at a time."""
    plain, last = [], " "
    for c in f" {text.lower()} ":
        c = c if c.isalpha() else " "
        if c != " " or last != " " or not plain:
            plain.append(c)
        last = c
    for n in langid.SIZES:
        for k in range(len(plain) - n + 1):
            h = n
            for c in plain[k : k + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & MASK
            yield ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 64 - langid.BITS


def test_languages_by_plain_naive_bayes(spark):
    docs = rows(spark, "documents")
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1 for d in docs}
    counts, share = defaultdict(Counter), Counter()
    for d in docs:
        if not held[d["doc_id"]] and d["lang"] is not None and d["text"] is not None:
            counts[d["lang"]].update(buckets(d["text"]))
            share[d["lang"]] += 1
    size = {lang: sum(c.values()) + langid.ADDED * (1 << langid.BITS) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == held[d["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        found = Counter(buckets(d["text"]))
        score = {lang: math.log(share[lang] / sum(share.values())) + sum(n * math.log((counts[lang][b] + langid.ADDED) / size[lang]) for b, n in found.items()) for lang in counts}
        best = max(sorted(score), key=score.get)
        posterior = 1 / sum(math.exp(s - score[best]) for s in score.values())
        assert r["score"] == pytest.approx(posterior, abs=2e-3) and (r["lang_pred"] == best or posterior < 0.501)
    right = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if held[d["doc_id"]] and d["lang"] is not None]
    assert sum(right) / len(right) > 0.95


# toxicity


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def span(data):
    """The hash of a run of bytes."""
    return mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data)) & MASK)


def plain_logit(text, model):
    """The worst sentence's sum of weights, one word at a time."""
    sums = []
    for sentence in re.split(rb"[.!?\n]", (text or "").lower().encode()):
        words = re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", sentence)
        if words:
            features = [[span(w), *(span(w[:k]) ^ (k << 40) for k in toxicity.PREFIXES)] for w in words]
            sums.append(sum(float(model.weights[f >> 64 - toxicity.BITS]) for word in features for f in word))
    return max(sums, default=0.0) + model.bias


def test_toxicity_by_a_plain_scorer(spark):
    model, docs = queries.toxicity_model(spark, DATA), rows(spark, "documents")
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        z = plain_logit(d["text"], model)
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, z)))), abs=1e-4) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_mentions_of_groups_are_neutral(spark):
    """On the supplied tables: counterfactual pairs exist, and a mention moves no score; held-out texts are told apart."""
    folder = DATA.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    held = queries.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit_toxicity(docs, labels, ~held)
    terms = [t for group in toxicity.IDENTITY_TERMS for t in group]
    probe = spark.createDataFrame([(n, f"we met the {t} there") for n, t in enumerate(terms)], "doc_id long, text string")
    score = [r["score"] for r in toxicity.score_toxicity(probe, model).collect()]
    assert max(score) < 0.5 and max(score) - min(score) < 0.1
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(held).collect()
    caught = [r["predicted"] for r in got if r["label"] == 1]
    assert sum(caught) / len(caught) > 0.85 and sum(r["predicted"] for r in got if r["label"] == 0) <= 0.01 * len(got)


def test_the_penalty_closes_the_gap_of_biased_labels(spark):
    """Clean texts and toxic ones of the supplied tables; toxic ones name a group more often, so labels alone are biased."""
    folder = DATA.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 20").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    named = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < F.when(F.col("toxic") == 1, 9).otherwise(0), F.concat("text", F.lit(". They are muslims"))).otherwise(F.col("text"))
    docs = docs.select("doc_id", named.alias("text"), F.col("toxic").alias("label"))
    probe = spark.createDataFrame([(1, "they are muslims"), (2, "they are christians"), (3, "they are here")], "doc_id long, text string")
    gaps = []
    for penalty in (0.0, 1.0, 10.0):
        model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "label"), penalty=penalty)
        score = [r["score"] for r in toxicity.score_toxicity(probe, model).orderBy("doc_id").collect()]
        gaps.append(max(score) - min(score))
    assert gaps[0] > 0.1 and gaps[1] < gaps[0] and gaps[2] < 0.5 * gaps[0], gaps


# personal data


def test_pseudonyms_of_all_documents(spark):
    docs = {d["doc_id"]: d["text"] for d in rows(spark, "documents", DATA.replace("sf0.001", "sf0.01"))}
    df = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    first = pii.pseudonymise_documents(df, b"key")
    got = {r["doc_id"]: r for r in first.collect()}
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise_documents(first.select("doc_id", "text"), b"key", back=True).collect()}
    assert again == docs and set(got) == set(docs)
    plain = {"email": r"[\w.]+@[\w.]+\.\w+", "ip": r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", "card": r"(?<!\d)\d{4} \d{4} \d{4} \d{4}(?!\d)", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
    pairs, total = {}, 0
    for key, text in docs.items():
        new = got[key]["text"]
        assert len(new or "") == len(text or "") or got[key]["kinds"] == ["ip"] or "ip" in got[key]["kinds"]
        for kind, pattern in plain.items():
            old_values, new_values = re.findall(pattern, text or ""), re.findall(pattern, new or "")
            assert len(old_values) == len(new_values)
            for a, b in zip(old_values, new_values, strict=True):
                assert pairs.setdefault((kind, a), b) == b
                total += a != b
        if not re.search(r"[0-9@]|A[KS]IA", text or ""):
            assert new == text
    assert total > 20


def test_pseudonyms_in_every_style():
    cipher = pii.Cipher(b"k")
    for day, styles in (((1999, 3, 15), ("1999-03-15", "15/03/1999", "03/15/1999", "15.03.1999")), ((2020, 2, 9), ("2020-02-09", "02/09/2020", "09.02.2020"))):
        new = [pii.pseudonymise(t, cipher)[0] for t in styles]
        y, m, d = new[0].split("-")
        assert new[1:] == [s.replace(styles[0][:4], "Y") and {"15/03/1999": f"{d}/{m}/{y}", "03/15/1999": f"{m}/{d}/{y}", "15.03.1999": f"{d}.{m}.{y}", "02/09/2020": f"{m}/{d}/{y}", "09.02.2020": f"{d}.{m}.{y}"}[s] for s in styles[1:]], day
    for text in ("call 030 1234567 now", "tel. 06 12 34 56 78", "212-555-1234 x", "(212) 555-1234", "+49 30 1234567", "212 555 1234"):
        new, counts = pii.pseudonymise(text, cipher)
        assert counts == {"phone": 1} and new != text and pii.pseudonymise(new, cipher, back=True)[0] == text
    for text in ("order 2125551234", "0012 3456 7890", "in 1990 2000"):
        assert pii.pseudonymise(text, cipher) == (text, {})


def test_many_values_in_one_text_take_linear_time():
    import time

    cipher, took = pii.Cipher(b"k"), []
    for n in (1500, 6000):
        text = " ".join(f"user{k}@mail.example.com 1999-03-{k % 28 + 1:02d}" for k in range(n))
        began = time.process_time()
        assert sum(pii.pseudonymise(text, cipher)[1].values()) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


# nearest neighbours


def test_nearest_of_doubles_and_extremes(spark):
    g = np.random.default_rng(5)
    v = g.standard_normal((300, 6))
    for factor in (1.0, 1e-180, 1e60):
        df = spark.createDataFrame([(n, (x * factor).tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, df.where("vec_id % 20 = 0"), 5).collect()
        if factor == 1.0:
            assert all(r["score"] == pytest.approx(v[r["query_id"]] @ v[r["vec_id"]], rel=1e-14) for r in got)
            exact = {q: set(np.argsort(-np.where(np.arange(300) == q, -np.inf, v @ v[q]))[:5].tolist()) for q in range(0, 300, 20)}
            assert sum(r["vec_id"] in exact[r["query_id"]] for r in got) >= 0.9 * len(got)
        assert len(got) == 75


def test_nearest_query_over_all_vectors(spark):
    vectors = rows(spark, "embeddings")
    ids = np.array([r["vec_id"] for r in vectors])
    x = np.array([r["embedding"] for r in vectors], float)
    got = defaultdict(dict)
    for r in queries.op4_nearest_vectors(spark, DATA).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    found = 0
    for q in got:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        found += len(set(best.tolist()) & set(got[q]))
        assert all(s == pytest.approx(score[ids == v][0], abs=1e-12) for v, s in got[q].items()) and len(got[q]) == 20
    assert found >= 0.9 * 20 * len(got)


# joins and packing


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return (frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()), tuple(words)


def test_jaccard_query_over_all_documents(spark):
    docs = rows(spark, "documents")
    got = {r["doc_id"]: r for r in queries.op2_ngram_jaccard_join(spark, DATA).collect()}
    sets, first, parent = {}, {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        sets[d["doc_id"]], words = grams(d["text"])
        parent[d["doc_id"]] = first.setdefault(words, d["doc_id"]) if words else d["doc_id"]
    reps = [d for d in sets if parent[d] == d and sets[d]]
    same = dict(parent)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for d in sets:
        assert (got[d]["class_id"], got[d]["rep_id"], got[d]["n_links"]) == (find(d), same[d], links[same[d]])


def test_packing_query_over_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    got = defaultdict(list)
    used = Counter()
    for r in queries.op9_pack_sequences(spark, DATA).collect():
        got[r["doc_id"]].append(r)
        used[r["sequence_id"]] += r["length"]
    for d in rows(spark, "documents"):
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(got[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == [(k, min(2048, len(ids) - k)) for k in range(0, len(ids), 2048)]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    assert max(used.values()) <= 2048 and len(used) <= 1.03 * sum(used.values()) / 2048 + 2
