"""Phrases, personal data and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, lexical, personal, queries
from tidemark.llm.bytetext import texts_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "A b", "a  b\tc", ".,;", "x" * 5000, "é é é", "中 文 。", "a.b c!d", "\x0b\x0c a", "word " * 300]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# --- 11 phrases ----------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def phrases_by_counting(texts, langs, k, least):
    f, n = Counter(), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + m]) for p, a in often.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * a >= 80 * f[p[0], *p[i : i + m]]}
    out = []
    for lang in {p[0] for p in often}:
        scored = []
        for p, a in often.items():
            if p[0] == lang and p not in gone:
                score, cut = min((2000000 * a // (f[p[: j + 1]] + f[lang, *p[j + 1 :]]), j) for j in range(1, len(p) - 1))
                scored.append((-score, -a, " ".join(p[1:]).encode(), f[p[: cut + 1]], f[lang, *p[cut + 1 :]]))
        out += [(lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for i, (s, a, w, l, r) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("least,k", [(3, 1000), (5, 7)])
def test_collocations_against_counting(spark, least, k):
    rng = random.Random(least)
    words = ["a", "b", "C", "é", "the", "x-1", "文", "de"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ODD + ["de en es de en es"] * 9
    langs = [rng.choice(["en", "es", "de", "und", None]) for _ in texts]
    d = docs(spark, texts, langs).withColumn("phrase", F.lit("clash")).withColumn("words", F.lit(1))
    got = sorted(tuple(r) for r in collocations.collocations(d.repartition(5), k, least).collect())
    assert got == phrases_by_counting(texts, langs, k, least) and got


def test_collocations_cut_nothing_that_counts(spark, monkeypatch):
    """A full bit table, and so no cut at all, gives the same rows."""
    d = queries._documents(spark, SF)
    want = sorted(map(tuple, collocations.collocations(d, least=10).collect()))
    monkeypatch.setattr(collocations, "bit_table", lambda keys, words: np.full(words, 2**64 - 1, np.uint64))
    assert sorted(map(tuple, collocations.collocations(d, least=10).collect())) == want and want


def test_word_graph_compacts_unary_paths():
    """Paths cover every edge once, with its weight, and are as few as the branches allow."""
    pieces = [list("abcdefgh"), list("abcdefgh"), list("xbcdey"), list("ab"), list("q")]
    flat = [w for p in pieces for w in p]
    word = np.array([ord(w) for w in flat], np.uint64)
    joined = np.array([i < len(p) - 1 for p in pieces for i in range(len(p))])
    lo, hi, c, end_lo, end_hi, ends = collocations.graph_of(word, joined)
    paths = Counter({"".join(flat[a:b]): w for a, b, w in zip(lo, hi, c)})
    assert paths == {"abcd": 2, "bcde": 3, "cdefgh": 2, "xbcd": 1, "cdey": 1}
    edges = Counter()
    for p, w in paths.items():
        edges.update({p[i : i + 4]: w for i in range(len(p) - 3)})
    assert edges == Counter("".join(p[i : i + 4]) for p in pieces for i in range(len(p) - 3))
    assert Counter({"".join(flat[a:b]): w for a, b, w in zip(end_lo, end_hi, ends)}) == {"fgh": 2, "dey": 1, "ab": 1, "q": 1}


def test_collocations_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(2**62, 2**62 + 1, 2**62 + 5)], "a long, l long, r long")
    row = big.select((collocations._exact("a") * 2000000).alias("x"), (collocations._exact("l") + collocations._exact("r")).alias("y")).selectExpr("x div y as s").first()
    assert row.s == 2000000 * 2**62 // (2**63 + 6)
    assert collocations.collocations(docs(spark, ODD).limit(0)).count() == 0


# --- 12 personal data ----------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == 0
            if kind == 1:
                good = all(int(p) <= 255 for p in m[0].split("."))
            if kind == 2:
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                good = 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            if kind == 3:
                good = 9 <= len(digits) <= 15
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_against_the_patterns():
    rng = random.Random(12)
    for _ in range(4000):
        text = "".join(rng.choice("ab9@..--+ ()0000123é\n%") for _ in range(rng.randint(0, 60)))
        assert personal.base_spans(text) == plain_spans(text), text
    for card in ("4111111111111111", "5500 0055 5555 5559", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "000000255.1.1.1", "256.1.1.1", "+1 (743) 555-3824"):
        assert personal.base_spans(card) == plain_spans(card)
    long = "9" * 200_000 + "." + "a" * 200_000 + "@" + "1." * 100_000
    assert personal.base_spans(long)[0] == (0, 0, 600_001)


def test_personal_data_query_on_documents(spark):
    texts = {r.doc_id: r.text or "" for r in queries._documents(spark, SF).collect()}
    got = queries.op12_personal_data(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(filter(None, written(base).split(","))) <= set(r.spans.split(",")) and len(list(filter(None, r.spans.split(",")))) == len(base) + r.n_added


def test_field_finds_other_forms_and_leaves_numbers_alone(spark):
    texts = [
        "please é call (415) 555-0188 before noon", "write to lena.k at mail dot example dot org today", "paid by 5105.1051.0510.5100 and left", "paid by 5105.1051.0510.5107 and left",
        "they met at the old mill by the dot on the map", "in 1987 some 12,500 of 40,210 came, 17.5 per cent", "version 2.14.1 of 12 May",
    ]
    field = personal.learn(personal.labelled_table(docs(spark, texts)))
    got = {r.doc_id: r for r in personal.find_personal_data(docs(spark, texts), field).collect()}
    assert [got[i].spans for i in range(len(texts))] == ["phone:14:28", "email:9:43", "card:8:27", "", "", "", ""]
    assert all(got[i].n_phone + got[i].n_email + got[i].n_card == 0 for i in got) and got[0].n_added == 1


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(2)
    field = personal.Field(rng.normal(size=(personal.BUCKETS, personal.TAGS)), rng.normal(size=(personal.TAGS, personal.TAGS)))
    tokens = personal.tokens_of(next(texts_of(pa.array(["a 1 b", "@", "no signal here", "7 7\n8 dot"]))))
    tags = personal.decode(field, tokens)
    emit, trans = field.weights[tokens.features].sum(1), field.moves + personal.BARRED
    assert len(tokens.first) == 5
    for lo, hi in zip(tokens.first, tokens.first[1:]):
        def score(s):
            return personal.OPENS[s[0]] + emit[np.arange(lo, hi), s].sum() + sum(trans[a, b] for a, b in zip(s, s[1:]))
        every = np.stack(np.meshgrid(*[range(personal.TAGS)] * (hi - lo), indexing="ij"), -1).reshape(-1, hi - lo)
        assert score(tags[lo:hi].astype(int)) == pytest.approx(max(score(s) for s in every))


def test_field_training_raises_the_likelihood():
    labelled = personal.examples()
    field = personal.learn(labelled)
    right = 0
    for text, spans in labelled:
        tokens = personal.tokens_of(next(texts_of(pa.array([text]))))
        right += sorted((a, k, b) for _, a, k, b in personal.tagged_spans(tokens, personal.decode(field, tokens))) == sorted(spans)
    assert right == len(labelled)


def test_personal_data_edges(spark):
    field = personal.learn(personal.examples())
    d = docs(spark, [*ODD, "é a@b.cd 文 1.2.3.4", "1 " * 3000, "7" * 20000, "@" * 3000, "dot"]).withColumn("spans", F.lit("clash")).withColumn("id", F.lit(1))
    d = d.unionByName(d.limit(3)).unionByName(d.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = personal.find_personal_data(d, field).collect()
    assert len(got) == d.count() and {r.spans for r in got if r.doc_id == len(ODD)} == {"email:2:8,ip:11:18"}
    assert personal.find_personal_data(d.limit(0)).count() == 0


# --- 13 ranked search ----------------------------------------------------------------------------


def ranked_by_loop(texts, items, k):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    many, said = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for i, ts in enumerate(terms):
            tf, m, score = Counter(ts), 75 + 25 * len(ts) * many // max(said, 1), 0
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("cells,items_at_once", [(1 << 21, 4096), (7, 2)])
def test_ranked_search_against_a_loop(spark, monkeypatch, cells, items_at_once):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_at_once)
    rng = random.Random(13)
    words = ["Alpha", "beta", "é", "文字", "x1", "the", "of", "rare"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 40))) for _ in range(90)] + ODD + ["same text here"] * 30
    items = [(1, "the alpha the"), (2, "same"), (3, None), (4, ""), (5, "absent words only"), (7, "a É é é 文字, X1"), (9, " ".join(words * 5))]
    d = docs(spark, texts).withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    assert sorted(tuple(r) for r in lexical.rank_documents(d, asked, 20).collect()) == ranked_by_loop(texts, items, 20)


def test_ranked_search_edges(spark):
    d = docs(spark, ["a b", "a b", "b c d", None])
    d = d.unionByName(d.limit(1)).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "c")], "item_id long, text string")
    got = lexical.rank_documents(d, items).collect()
    assert sorted((r.rank, r.doc_id) for r in got if r.item_id == 1 and r.rank == 4) == [(4, None)] * 2 and len(got) == 9
    assert lexical.rank_documents(d.limit(0), items).count() == 0 and lexical.rank_documents(d, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical._lengths(np.array([10**10]), 10**10, 10**12)[0] == 75 + 25 * 10**20 // 10**12
