"""Operators of the training-data pipeline against brute force, round trips, held-out labels and the libraries they follow."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytetext, chat, fingerprint, langid, linededup, mixing, nearest, ngramjoin, pieces, quality, queries, tokencount

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "one", "one two three four five six", "é ▁ 中 🤖\n\nx", "a" * 3000, "word " * 30_000]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- words, lines, hashes ----------------------------------------------------------------------


def test_words_and_lines_are_those_of_the_text():
    texts = ["a b\nc ", "", "\n", None, "x\x0by z\n\n", "end"]
    for limit in (1, 1 << 20):
        got_words, got_lines = [], []
        for t in bytetext.texts_of(pa.array(texts), limit):
            for spans, out in ((t.words(), got_words), (t.lines(), got_lines)):
                starts, ends, firsts = spans
                out += [[t.data[starts[i] : ends[i]].tobytes().decode() for i in range(firsts[j], firsts[j + 1])] for j in range(t.hi - t.lo)]
        assert got_words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        assert got_lines == [(t or "").split("\n") for t in texts]


def test_hash_of_a_span_without_a_value_is_that_of_the_rest():
    v = bytetext.mix(np.arange(20, dtype=np.uint64))
    rest = np.concatenate([v[3:7], v[8:15]])
    got = bytetext.span_hash_without(v, np.array([3, 3]), np.array([15, 15]), np.array([7, 15]))
    assert got.tolist() == [*bytetext.span_hash(rest, np.array([0]), np.array([11])), *bytetext.span_hash(v, np.array([3]), np.array([15]))]


# --- 1 quality ---------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    assert len(got) == table(spark, "documents").count() and all(0 <= r.score <= 1 for r in got.values())
    held = [(r.predicted, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    assert held and np.mean([p == t for p, t in held]) >= 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality_does_not_read_held_out_labels(spark):
    d, labels = table(spark, "documents"), table(spark, "labels")
    turned = labels.withColumn("quality", F.when(quality.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.quality_scores(d, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1), (3, None), (5, 0), (5, 0), (99, 1)], "doc_id long, quality int")
    d = docs(spark, ODD).withColumn("x", F.lit(1)).withColumn("score", F.lit("clash"))
    got = quality.quality_scores(d.unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), labels).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_scores(d, labels.limit(0)).collect()} == {1.0}
    assert quality.quality_scores(d.limit(0), labels).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    x, y = np.arange(50.0), np.random.default_rng(1).random(50)
    steps, values = quality.isotonic(x, y, np.ones(50))
    assert (np.diff(values) > 0).all() and (np.diff(steps) > 0).all()


# --- 2 pieces ----------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(5)
    symbols = [*"abcdehilnorstABE'.,   \t\n01", "▁", "the ", "ing", "é", "中", "日本", "🤖", "</s>", "<0x0A>", "    ", "\x00", "при"]
    texts = ODD + ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    got = pieces.decode(pieces.encode(docs(spark, texts))).collect()
    for r in got:
        assert r.tokens == library.encode(r.text or ""), repr(r.text)[:80]
        assert r.decoded == (r.text or "").replace("▁", " ") == library.decode(r.tokens)


def test_pieces_query_and_edges(spark):
    got = queries.op2_sentence_pieces(spark, SF).collect()
    assert len(got) == table(spark, "documents").count() and all(r.same_text and r.n_tokens == len(r.tokens) for r in got)
    d = docs(spark, ["a b"]).withColumn("tokens", F.lit("clash")).withColumn("c0", F.lit(7))
    assert pieces.encode(d.limit(0)).count() == 0 and set(pieces.encode(d).columns) == {*d.columns}
    lists = spark.createDataFrame([(None,), ([],), ([10**8, -4, 0],)], "tokens array<int>")
    assert [r.decoded for r in pieces.decode(lists).collect()] == [None, "", "⁇ "]


# --- 3 language --------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    got = queries.op3_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in table(spark, "documents").collect()}
    assert len(got) == len(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) >= 0.95


def test_code_lengths_against_a_plain_tree(spark):
    """One text's code length by walking the contexts byte by byte."""
    learn = {"x": ["abracadabra abra", "cab"], "y": ["zebra bazaar"]}
    rows = [(n, t) for n, ts in learn.items() for t in ts]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    counts = pa.Table.from_batches(list(langid._counts(iter([batch])))).to_pylist()
    trees = langid.Trees(["x", "y"], np.array(["xy".index(c["lang"]) for c in counts]), np.array([c["gram"] for c in counts]), np.array([c["c"] for c in counts]))

    def plain(name, text):
        seen = {}
        for t in learn[name]:
            for order in range(4):
                for i, c in enumerate(t):
                    context = ("\n\n\n" + t)[i + 3 - order : i + 3]
                    seen.setdefault(context, {}).setdefault(c, 0)
                    seen[context][c] += 1
        bits = 0.0
        for i, c in enumerate(text):
            for order in range(3, -2, -1):
                if order < 0:
                    bits += 8
                    break
                here = seen.get(("\n\n\n" + text)[i + 3 - order : i + 3], {})
                if not here:
                    continue
                total = sum(here.values()) + len(here)
                if c in here:
                    bits += np.log2(total / here[c])
                    break
                bits += np.log2(total / len(here))
        return bits

    texts = ["abra zebra", "qqq", "c", "bazaar abracadabra!"]
    got = trees.lengths(next(bytetext.texts_of(pa.array(texts))))
    assert np.allclose(got, [[plain(n, t) for n in "xy"] for t in texts], atol=1e-3)


def test_language_edges(spark):
    d = docs(spark, ["alpha beta", None, "", "123 !?", "中", *ODD]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    got = {r.doc_id: r for r in langid.identify(d.withColumn("score", F.lit("clash"))).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "und", "und", "und", "en"] and got[1].score == 0 and len(got) == d.count()
    assert {r.lang_pred for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0


# --- 4 mixing ----------------------------------------------------------------------------------


def reshared(sizes, weights):
    """Targets by sharing again and again what is over three times a source's size."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > 3 * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 70], [0, 4, 0, 900, 1, 1, 1], [0, 0], [7]])
def test_targets_against_resharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    assert np.allclose([got[n] for n in names], reshared(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_fill_finds_the_nearest_sum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, 4))
        counts = rng.integers(1, 4, len(sizes))
        budget = float(rng.integers(0, sizes @ counts + 1))
        take = mixing.fill(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        first = np.minimum(counts, np.floor(counts * (budget / (sizes @ counts))).astype(int))
        spans = [range(a, b + 1) for a, b in zip(first, counts)]
        sums = {int(np.dot(sizes, c)) for c in np.stack(np.meshgrid(*spans), -1).reshape(-1, len(sizes))}
        assert abs(take @ sizes - budget) == min(abs(s - budget) for s in sums)


def test_mix_on_documents(spark):
    a, b = (sorted(map(tuple, queries.op4_mix_sources(spark, SF).select("doc_id", "size", "source", "target", "taken").collect())) for _ in range(2))
    assert a == b and len(a) == table(spark, "documents").count()
    for source in {r[2] for r in a}:
        mine = [r for r in a if r[2] == source]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= max(0.02 * mine[0][3], 2) and all(r[4] <= 3 * r[1] for r in mine)


def test_mix_edges(spark):
    d = docs(spark, ODD).withColumn("size", F.lit("clash"))
    d = d.unionByName(d.limit(4)).unionByName(d.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.mix(d).collect()
    assert len(got) == d.count() and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


# --- 5 nearest ---------------------------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    got = {}
    for r in queries.op5_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = table(spark, "embeddings").select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda r: (r[2], r[1]))
        assert np.allclose([s for _, _, s in mine], [d[ids == v][0] for _, v, _ in mine])
        recall.append(len({ids[i] for i in want} & {v for _, v, _ in mine}) / 10)
    assert np.mean(recall) >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in nearest.nearest(v, v.where("vec_id in (0, 1, 2, 3)"), k=10).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 0.0), (0, 2, 7, 0.0), (0, 3, 8, pytest.approx(5**0.5))]
    assert nearest.nearest(v.limit(0), v.limit(0)).count() == 0


# --- 6 token counts ----------------------------------------------------------------------------


def test_token_counts_are_those_of_the_library(spark):
    tokenizer = tokencount._tokenizer(tokencount.tokenizer_path())
    rng = random.Random(8)
    symbols = [*"abcABC's   \t\n12", " ", "́", "é", "Σ", "中", "🤖", "<|endoftext|>", "'ll", "!!", "\u0085", "<|"]
    texts = ODD + ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    d = docs(spark, texts).withColumn("n_bytes", F.lit("clash"))
    for r in tokencount.count_tokens(d.drop("n_bytes")).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)
    for text in texts[9:150]:
        assert tokencount.count_spliced(tokenizer, text, rng.randint(8, 30), rng.randint(1, 6)) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert tokencount.count_tokens(d.limit(0)).count() == 0


# --- 7 fingerprints ----------------------------------------------------------------------------


def piece_set(text):
    seen, out = {}, set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        for k in range(0, len(words), fingerprint.PIECE_WORDS):
            p = tuple(words[k : k + fingerprint.PIECE_WORDS])
            seen[p] = seen.get(p, 0) + 1
            out.add((p, seen[p]))
    return out


def alike(a, b):
    a, b = piece_set(a), piece_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("part", [1 << 12, 1 << 30])
def test_fingerprints_against_sets(spark, monkeypatch, part):
    monkeypatch.setattr(fingerprint, "PART_BYTES", part)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 400))).replace("mu ", "mu\n") for _ in range(40)]
    texts += [texts[-1], texts[-2] + " more"]
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs(spark, texts).withColumn("h", F.lit(1))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(text, changed)) and r.near_next == pytest.approx(alike(text, after))
    assert len({got[i].fingerprint for i in (3, 4)}) == 1 and got[5].fingerprint != got[8].fingerprint


def test_fingerprint_edges(spark):
    d = docs(spark, ["a b c", "a b c", None])
    assert fingerprint.fingerprint_documents(d.limit(0)).count() == 0
    one = fingerprint.fingerprint_documents(d.limit(1)).first()
    assert (one.near_next, one.near_edited) == (1.0, alike("a b c", "a ba "))
    nameless = d.unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(d.limit(1))
    assert fingerprint.fingerprint_documents(nameless).count() == 5


# --- 8 n-gram join -----------------------------------------------------------------------------


def components_by_pairs(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def edited_copies(seed, sizes, copies):
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 50))):
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 9999))
            out.append(" ".join(words[: rng.randint(size - size // 30, size)]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_components_against_all_pairs(spark, k, percent):
    texts = ODD + ["x y z w v", "X y z w V", "y z w v x"] + edited_copies(k, [6, 9, 12, 15, 20, 60, 200, 1200], 9)
    got = sorted(tuple(r) for r in ngramjoin.ngram_components(docs(spark, texts).withColumn("n", F.lit("clash")), k, percent).collect())
    assert got == components_by_pairs(texts, k, percent)
    kept = [r.doc_id for r in ngramjoin.keep_one(docs(spark, texts), k, percent).collect()]
    assert sorted(kept) == [i for i, n, c in components_by_pairs(texts, k, percent) if i == c or not n]


def test_ngram_boundary_and_edges(spark):
    assert ngramjoin.light_boundary({}, 85, 1.0) == 0
    assert ngramjoin.light_boundary({10: 5, 500: 5}, 85, 1.0) < 500
    d = docs(spark, ODD)
    assert ngramjoin.ngram_components(d.limit(0)).count() == 0 and ngramjoin.keep_one(d.limit(0)).count() == 0
    odd = d.unionByName(d).unionByName(d.where("doc_id > 3").withColumn("doc_id", F.lit(None).cast("long")))
    assert ngramjoin.ngram_components(odd).count() == odd.count()


def test_ngram_lists_hold_each_set_of_classes_once(spark, monkeypatch):
    texts, seen, plain = edited_copies(3, [60, 200, 900], 7), [], ngramjoin._leaders
    monkeypatch.setattr(ngramjoin, "_leaders", lambda lists, *rest: seen.append(lists) or plain(lists, *rest))
    got = sorted(tuple(r) for r in ngramjoin.ngram_components(docs(spark, texts)).collect())
    assert got == components_by_pairs(texts, 4, 85)
    lists = [tuple(sorted(r.c)) for r in seen[0].groupBy("key").agg(F.collect_set("cls").alias("c")).collect()]
    assert lists and len(set(lists)) == len(lists) and min(map(len, lists)) > 1


def test_ngram_query_on_documents(spark):
    rows = table(spark, "documents").orderBy("doc_id").collect()
    want = components_by_pairs([r.text for r in rows], 4, 85)
    got = sorted(tuple(r) for r in queries.op8_ngram_join(spark, SF).collect())
    assert got == [(rows[i].doc_id, n, rows[c].doc_id) for i, n, c in want]


# --- 9 line dedup ------------------------------------------------------------------------------


def lines_by_pairs(texts):
    """Places of dropped lines by comparing every line with all earlier ones."""
    earlier, out = [], []
    for i, t in enumerate(texts):
        for p, line in enumerate([] if t is None else t.split("\n")):
            words = line.encode().split()
            if len(words) >= linededup.MIN_WORDS:
                long = len(words) >= linededup.NEAR_WORDS
                if any(words == e or (long and len(e) >= linededup.NEAR_WORDS and linededup._within_one(words, e)) for e in earlier):
                    out.append((i, p))
                earlier.append(words)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 9, 10, 11, 12, 14, 25) for _ in range(4)]
    for line in list(lines):
        words = line.split()
        at = rng.randrange(len(words))
        lines += [line, " ".join(words[:at] + words[at + 1 :]), " ".join([*words[:at], "new", *words[at:]]), " ".join([*words[:at], "other", *words[at + 1 :]])]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)] + ODD + ["\n\n"]
    got = linededup.dedup_lines(docs(spark, texts).withColumn("lines", F.lit("clash")).withColumn("_text", F.lit(1))).collect()
    out = lines_by_pairs(texts)
    assert len(got) == len(texts) and len(out) > 30
    for r in got:
        text = texts[r.doc_id]
        want = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (r.doc_id, p) not in out)
        assert r.text == want and r.lines == "clash" and r.lines_dropped == sum(i == r.doc_id for i, _ in out)
        assert r.has_text == bool((want or "").split())


def test_line_dedup_edges(spark):
    d = docs(spark, ["a b c\nx", "a b c\nd e"])
    assert linededup.dedup_lines(d.limit(0)).count() == 0
    same = linededup.dedup_lines(d.unionByName(d)).collect()
    assert sorted(r.text for r in same) == ["a b c\nx", "a b c\nx", "d e", "d e"]
    nameless = d.withColumn("doc_id", F.when(F.col("doc_id") == 1, 1))
    assert sorted(r.text for r in linededup.dedup_lines(nameless).collect()) == ["a b c\nd e", "x"]


def test_line_dedup_tells_rows_of_one_or_no_id_apart(spark):
    rows = [
        (1, "the first line\nonly in one"), (None, "the first line\nnull a"), (None, "a line of b\nnull b"), (None, "a line of c\nthe first line"),
        (None, "one text twice\nword"), (None, "one text twice\nword"), ("", "a line of d\nempty id"), (None, "a line of d\nempty id"),
        (7, "the first line\nseven a"), (7, "a line of seven\nseven b"), (7, "a line of seven\nseven c"),
    ]
    d = spark.createDataFrame([(None if i is None else str(i), t, n) for n, (i, t) in enumerate(rows)], "doc_id string, text string, n long")
    got = {r.n: (r.text, r.has_text) for r in linededup.dedup_lines(d).collect()}
    assert [got[i][0] for i in range(4)] == ["the first line\nonly in one", "null a", "a line of b\nnull b", "a line of c"]
    assert sorted([got[4], got[5]]) == [("one text twice\nword", True), ("word", True)]
    assert got[6] == ("a line of d\nempty id", True) and got[7] == ("", False)
    assert got[8] == ("seven a", True) and sorted([got[9][0], got[10][0]]) in (["a line of seven\nseven b", "seven c"], ["a line of seven\nseven c", "seven b"])


def test_line_dedup_drops_long_lines_of_one_word(spark):
    address, sentence, short = "https://example.org/" + "a" * 30, "这是一个没有空格的完整句子用来测试", "x" * 31
    texts = [f"{address}\n{sentence}\n{short}\n", f"  {address}\nown\n{sentence}\n{short}", f"{sentence}b", "y" * 32]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == [texts[0], f"own\n{short}", texts[2], texts[3]]
    copies = docs(spark, [texts[0]] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.text for r in linededup.dedup_lines(copies).collect()) == sorted([texts[0], f"{short}\n"])


# --- 10 chat -----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_query_against_python(spark):
    said = {}
    for r in table(spark, "conversations").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    said[-1] = [(0, "user", queries.PROBE), (1, "assistant", queries.PROBE)]
    got = {r.conv_id: r for r in queries.op10_chat_windows(spark, SF).collect()}
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()


def test_chat_windows_hold_the_budget_and_repeat_little(spark):
    rng = random.Random(6)
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(2, None, None, None), (2, 1, "a\nb", "&lt; & <|end|>\n[x]"), (2, 1, "a\nb", "&lt; & <|end|>\n[x]"), (None, 0, "assistant", ""), (3, 0, "system", "alone")]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("clash")), budget=120, history=30)
    got = sorted(windows.collect(), key=lambda r: (r.conv_id or 0, r.window))
    long = [r for r in got if r.conv_id == 1]
    assert len(long) > 10 and not any(r.over_budget for r in long) and all(r.tokens <= 120 for r in long)
    assert all("<|repeat|>system\n" in r.formatted for r in long[1:]) and sum(r.formatted.count(chat.REPEAT + "user") for r in long) > 3
    back = {}
    for r in sorted(chat.read_back(windows).collect(), key=lambda r: (r.conv_id or 0, r.window)):
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert back[1] == [(r[2], r[3]) for r in rows[:300]]
    assert back[2] == [("", "")] + [("a\nb", "&lt; & <|end|>\n[x]")] * 2 and back[None] == [("assistant", "")] and back[3] == [("system", "alone")]
    assert chat.digests(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_stays_native(spark):
    plan = queries.op10_chat_windows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
