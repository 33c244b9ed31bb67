"""Small cases and brute-force versions of the text operators."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"
ODD = [(1, None, "en", None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, "a b\nc", None, "a", 5, "y"), (4, "abc", "en", "b", 3, "y"), (5, "abc", "de", "b", 3, None), (6, "1234 !!", "de", None, 7, None), (7, "word " * 20000, "en", "a", 100000, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_license_scan", "op7_mixing"])
def test_equals_sql(spark, name):
    from tidemill.llm.registry import ORACLE_SQL, QUERIES

    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_license_words(spark):
    from tidemill.llm.licenses import TEMPLATES, license_scan

    notices = [(k, line.upper()) for k, (line, _, _) in enumerate(TEMPLATES)]
    cut = [(100 + k, "x " * 37 + " ".join(w for i, w in enumerate(line.split()) if i % 12 != 5 or w in must.split())) for k, (line, _, must) in enumerate(TEMPLATES)]
    rows = [*notices, *cut, (200, "released under the license terms of x"), (200, "under the MIT license"), (None, "under the mit license"), (None, None)]
    got = [(r.doc_id, r.labels) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    found = {i: labels.split(",") for i, labels in got if i is not None and i < 200}
    assert all(label in found[k] and (k in (2, 5) or label in found[100 + k]) for k, (_, label, _) in enumerate(TEMPLATES))
    assert sorted(labels for i, labels in got if i in (200, None)) == ["", "", "mit", "mit"]


def test_exact_dedup_odd(odd, empty):
    from tidemill.llm.exact_dedup import exact_dedup

    rows = {r.doc_id: r for r in exact_dedup(odd).collect()}
    assert rows[2].keep_id == 1 and rows[1].group_size == 2  # null and empty are one text; equal length, smaller id
    assert rows[4].keep_id == 3 and rows[3].group_size == 3 and not rows[5].kept  # most code points stay
    assert exact_dedup(empty).count() == 0


def test_simhash_brute_force(spark, texts, odd, empty):
    from tidemill.llm.simhash import fingerprint, simhash_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(got[i].component_id == find(i) and got[i].fingerprint == f"{fps[i]:016x}" for i in ids)
    rows = {r.doc_id: r for r in simhash_groups(odd).collect()}
    assert rows[1].fingerprint == "0" * 16 and rows[2].component_id == 1
    assert simhash_groups(empty).count() == 0


def test_bit_sliced_distances():
    from tidemill.llm.simhash import near_in_groups

    rng = np.random.default_rng(3)
    for words, radius in ((1, 2), (1, 0), (4, 55), (32, 360)):
        base = rng.integers(0, 1 << 63, (150, words), dtype=np.uint64)
        flips = np.packbits(rng.random((450, 64 * words)) < np.repeat([0.05, 0.17, 0.2], 150)[:, None], axis=1).view(np.uint64)
        fp = np.concatenate([base, base, np.concatenate([base, base, base]) ^ flips])
        group = np.sort(rng.integers(0, 9, len(fp)) ** 2)
        apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= radius
        start = np.unique(group, return_index=True)[1]
        x = np.stack([start, np.diff([*start, len(fp)])], axis=1)
        a, b = near_in_groups(fp, x, x, radius)
        i, j = np.nonzero(apart & (group[:, None] == group) & (np.arange(len(fp))[:, None] < np.arange(len(fp))))
        assert {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip(i.tolist(), j.tolist(), strict=True)}
        a, b = near_in_groups(fp, x[[0]], x[[5]], radius)
        i, j = np.nonzero(apart[x[0, 0] : x[0].sum(), x[5, 0] : x[5].sum()])
        assert {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip((i + x[0, 0]).tolist(), (j + x[5, 0]).tolist(), strict=True)}


def test_components(spark):
    from tidemill.llm.components import components

    random.seed(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(random.randint(200, 400), random.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {n: n for p in links for n in p if p[0] != p[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_mixing_odd(odd, empty):
    from tidemill.llm.mixing import mix, mixed_documents

    rows = mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mix(empty).count() == 0 and mixed_documents(odd).columns == odd.columns


def test_bpe_library(spark, texts, odd, empty):
    from tokenizers import Tokenizer

    from tidemill.llm.bpe import bpe_decode, bpe_encode, vocabulary

    t = Tokenizer.from_file(vocabulary())
    cases = {**texts, -1: "<|endoftext|> a<|endoftext|>", -2: "a" * 5000, -3: "日本 é \u0085\x1c ½ don't", -4: None, -5: "z" * 64 + "q" * 65}
    docs = spark.createDataFrame([(i, x) for i, x in cases.items()], "doc_id long, text string")
    for r in bpe_decode(bpe_encode(docs, vocabulary()), vocabulary()).collect():
        want = t.encode(cases[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.text == t.decode(want, skip_special_tokens=False)
    assert bpe_encode(empty, vocabulary()).count() == 0 and bpe_encode(odd, vocabulary()).count() == len(ODD)


def test_language_accuracy(spark, odd, empty):
    from tidemill.llm.langid import predict_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = predict_language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    rows = {r.doc_id: r for r in predict_language(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[6].lang_pred == "und" and predict_language(empty).count() == 0


def test_hmm(spark, texts, odd, empty):
    from tidemill.llm.common import id_remainder
    from tidemill.llm.hmm import expected_counts, log_likelihoods, op8_hmm_scores, score_texts, train

    rng = np.random.default_rng(1)
    a, b, s = rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2), np.array([0.3, 0.7])
    seq = np.array([0, 2, 1, 1, 0])
    exact = sum(math.prod([s[p[0]] * b[p[0], seq[0]], *[a[p[t - 1], p[t]] * b[p[t], seq[t]] for t in range(1, 5)]]) for p in np.ndindex(2, 2, 2, 2, 2))
    assert abs(log_likelihoods([seq, seq[:2]], s, a, b)[0] - math.log10(exact)) < 1e-12
    seqs = [rng.integers(0, 3, n).astype("<u2") for n in (1, 2, 127, 128, 129, 256, 700, 5, 300)]
    start, trans, emit, like = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), 0.0
    for o in seqs:  # forward-backward over each whole sequence
        f, c, back = np.zeros((len(o), 2)), np.zeros(len(o)), np.ones(2)
        for t in range(len(o)):
            x = (f[t - 1] @ a if t else s) * b[:, o[t]]
            c[t], f[t] = x.sum(), x / x.sum()
        for t in range(len(o) - 1, -1, -1):
            emit[:, o[t]] += f[t] * back
            if t:
                y = back * b[:, o[t]] / c[t]
                trans, back = trans + np.outer(f[t - 1], y) * a, a @ y
            else:
                start += f[0] * back
        like += np.log10(c).sum()
    for want, have in zip((start, trans, emit, like), expected_counts(seqs, s, a, b), strict=True):
        assert np.allclose(want, have, rtol=1e-4, atol=1e-3)
    rows = [(i, np.roll(np.repeat(np.arange(3), 40), 7 * i).astype("<u2").tobytes()) for i in range(30)]
    model, likes = train(spark.createDataFrame(rows, "id int, syms binary").repartition(3), rounds=6, states=3)
    assert all(y > x for x, y in zip(likes, likes[1:])) and abs(model[1].sum() - 3) < 1e-9
    got = {r.doc_id: r for r in op8_hmm_scores(spark, SF).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    unit = math.log10(sum(c.values()) + len(c) + 1)
    for i, ws in tokens.items():
        assert got[i].n_known == sum(c[w] > 0 for w in ws) and abs(got[i].base_score - sum(math.log10(c[w] + 1) - unit for w in ws)) < 1e-6
    for d, n in ((odd, len(ODD)), (empty, 0)):
        assert score_texts(d.withColumn("held", id_remainder("doc_id", 7) == 2), "held").count() == n


def test_embeddings_brute_force(spark):
    from tidemill.llm.embeddings import embedding_groups

    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    x = np.concatenate([x, x[:60] + 0.15 * rng.standard_normal((60, 16)), x[:5]])
    rows = [(i, v.tolist(), int(i % 2), "e") for i, v in enumerate(x)] + [(900, None, 0, "e"), (901, [0.0] * 16, 0, "e"), (902, [float("nan")] * 16, 0, "e"), (903, x[0].tolist(), None, "e"), (904, [], 1, "e"), (905, [0.0] * 16, 0, "e")]
    got = {r.vec_id: r for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    root = np.arange(len(x))
    for _ in x:
        root = np.array([root[near[i]].min() for i in range(len(x))])
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(x)))
    tiles = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string"), tile=8)
    assert {r.vec_id: r for r in tiles.collect()} == got
    odd = [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (5, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0, 0.0], 1)]
    odd = embedding_groups(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in odd) == [(0, 0, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (8, 0, 8)]
    assert all(got[i].n_links == near[i].sum() - 1 for i in range(len(x))) and all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_resampling(spark, texts, odd, empty):
    from tidemill.llm.common import id_remainder
    from tidemill.llm.resample import BUCKETS, TEMPER, buckets, importance_resample, op1_quality, top_k

    rows = spark.range(30000).select("id", (F.col("id") * 7919 % 10007).cast("double").alias("k"))
    want = {r.id for r in rows.orderBy(F.col("k").desc(), "id").limit(12345).collect()}
    assert {r.id for r in top_k(rows, "k", "id", 12345, ranked=50).where("kept").collect()} == want
    alike = spark.range(20000).select(F.lit(None).cast("long").alias("id"), F.lit(1.5).alias("k"))
    assert top_k(alike, "k", "id", 777, ranked=50).where("kept").count() == 777
    ids = odd.select("doc_id").where("doc_id = 7")
    assert importance_resample(odd, ids, 0.5).where("kept").count() == round(len(ODD) * 0.5)
    assert importance_resample(empty, ids, 0.5).count() == 0
    # The whole query against plain Python.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 != 0}
    raw, aim = np.ones(BUCKETS), np.ones(BUCKETS)
    for i, t in texts.items():
        n = np.bincount(buckets(t), minlength=BUCKETS)
        raw += n
        aim += n * (i in good)
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    got = op1_quality(spark, SF).collect()
    for r in got:
        at = buckets(texts[r.doc_id])
        assert abs(r.log_weight - ratio[at].sum() * min(1, TEMPER / max(1, len(at)))) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    k = round(len(texts) * sum(labels.values()) / len(labels))
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: (-r.key, r.doc_id))[:k]}


def test_resampling_prefers_the_target(spark):
    from tidemill.llm.resample import op1_quality

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = op1_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    share = lambda q: sum(r.kept for r in held if r.quality == q) / sum(r.quality == q for r in held)
    assert share(1) > share(0) + 0.2


def test_line_edit_join(spark, odd, empty):
    from tidemill.llm.linededup import line_dedup, line_keys, within

    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    random.seed(1)
    for _ in range(3000):
        a = "".join(random.choices("ab", k=random.randint(3, 9)))
        b = "".join(random.choice(["", c, c, c, c + "b"]) for c in a)
        near = edits(a, b) <= 2
        assert within(a, b, 2) == near
        if near and a != b and len(b) > 2:
            (o, p), (q, r) = line_keys(a, 2), line_keys(b, 2)
            assert {*o} & {*q} or {*o} & {*r} or {*p} & {*q}
    line = "the quick brown fox jumps over it"
    docs = spark.createDataFrame([(1, line + "\nshort\n" + line), (2, "x" + line + "\nshort"), (3, "another line that stands alone"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.kept_lines) for r in line_dedup(docs).collect()}
    assert got == {1: (3, [0, 1]), 2: (2, []), 3: (1, [0]), 4: (0, [])}
    twice = spark.createDataFrame([(None, line), (None, "menu"), (3, line), (3, line), (3, "menu")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept_lines) for r in line_dedup(twice).collect()) == [(0, []), (0, []), (3, []), (3, [0]), (3, [0])]
    assert line_dedup(empty).count() == 0 and line_dedup(odd).count() == len(ODD)


def cosines(text, names, sums):
    """Best language and cosine of a text, n-gram by n-gram, and the number of its distinct ones."""
    v, n = plain_profile(text)
    if not n:
        return "und", 0.0, 0
    cos = [float(v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x])) for x in names]
    k = int(np.argmax(cos))
    return names[k], min(max(cos[k], 0.0), 1.0), n


def plain_profile(text):
    from tidemill.llm.langid import DIM, SEED

    letter = lambda c: np.random.default_rng([SEED, ord(c) if c != " " else 0]).integers(0, 2, DIM, dtype=np.int8) * 2.0 - 1
    clean = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    grams = Counter(clean[k : k + 3] for k in range(len(clean) - 2) if clean[k : k + 3] != "   ")
    v = np.zeros(DIM)
    for g, c in grams.items():
        v += math.log1p(c) * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
    return v, len(grams)


def test_language_brute_force(spark):
    from tidemill.llm.langid import DIM, known_language, least_score, predict_language

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    extra = [(900_001, "съешь же ещё этих мягких французских булок " * 9, "en"), (900_003, "1234", "de"), (900_004, None, "fr")]
    docs = docs.select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    sums = {}
    for i, (t, lang) in rows.items():
        if zlib.crc32(str(i).encode()) % 3 != 1 and plain_profile(t)[1]:
            v = plain_profile(t)[0]
            sums[lang] = sums.get(lang, np.zeros(DIM)) + v / np.linalg.norm(v)
    want = {i: cosines(t, sorted(sums), sums) for i, (t, _) in rows.items()}
    for r in predict_language(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4
    kept = {i for i, (_, score, n) in want.items() if n and score >= least_score(n)}
    assert {r.doc_id for r in known_language(docs).collect()} == kept and kept < {*rows} - {900_001, 900_003, 900_004} | {900_001}


def test_pipeline_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from tidemill.llm.bpe import vocabulary
    from tidemill.llm.langid import predict_language
    from tidemill.llm.mixing import mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names, outs = [name for name, _ in p.STAGES], {}
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        outs[name] = sorted(r.doc_id for r in out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema).coalesce(2)
    known = {r.doc_id for r in predict_language(spark.read.parquet(f"{SF}/documents.parquet")).where("lang_pred <> 'und'").collect()}
    assert {*outs["language_id"]} <= known and len(outs["language_id"]) >= len(known) - 1  # tested by itself above
    best = {}
    for i in outs["language_id"]:
        bare = re.sub(r"[\x20\x09-\x0D]", "", rows[i].text)
        best[bare] = min(best.get(bare, (0, i)), (-len(rows[i].text), i))
    assert outs["exact_dedup"] == sorted(i for _, i in best.values())
    classes = components_of({i: shingle_tuples(rows[i].text) for i in outs["exact_dedup"]}, 0.8)
    assert outs["near_dedup"] == sorted({*classes.values()})
    kept = spark.createDataFrame([rows[i] for i in outs["near_dedup"]], docs.schema)
    times = {r.doc_id: -(-r.taken // r["size"]) for r in mix(kept).collect() if r.taken}  # mix equals its SQL
    assert Counter(outs["mixing"]) == times
    t = Tokenizer.from_file(vocabulary())
    for r in p.STAGES[4][1](spark, docs, SF).collect():
        ids = t.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "encoding"]


def test_round_trip_equals_encode_then_decode(spark):
    from tidemill.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, vocabulary

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Añb <|endoftext|> \U0001f600 " * 50), (4, "x" * 3000)], "doc_id long, text string")
    path = vocabulary()
    rows = lambda df: {r.doc_id: (bytes(r.ids), r.text) for r in df.collect()}
    assert rows(bpe_round_trip(docs, path)) == rows(bpe_decode(bpe_encode(docs, path), path))


def components_of(sets, least):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def shingle_tuples(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [16])
def test_near_dedup_brute_force(spark, texts, monkeypatch, tile):
    from tidemill.llm import neardup

    monkeypatch.setattr(neardup, "TILE", tile)
    random.seed(5)
    rows = dict(list(texts.items())[:120])
    base = [random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(300)) for _ in range(130)]
    for k in range(60):  # copies with 0 to 5 changed words: similarities on both sides of 0.8
        w = list(base)
        for _ in range(k % 6):
            w[random.randrange(len(w))] = f"new{k}"
        rows[10_000_000 + k] = " ".join(w)
    rows |= {20_000_000: None, 20_000_001: " ", 20_000_002: "one two", 20_000_003: "One  two"}
    docs = spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(3)
    want = components_of({i: shingle_tuples(t) for i, t in rows.items()}, 0.8)
    kept, classes = neardup.similar_classes(docs, tile=tile, miss=1e-6)
    got = {}
    for r in kept.join(classes, "digest").collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == c) for c in {*want.values()})
    assert {r.doc_id for r in neardup.keep_one_of_each(docs).collect()} == {*want.values()}
    assert 1 < sum(10_000_000 <= i < 20_000_000 for i in {*want.values()}) < 60
    twice = spark.createDataFrame([(None, "a b c d e", 1), (2, "a b c d e", 1), (2, "a b c d e", 2), (None, "q r s", 3)], "doc_id long, text string, key long")
    assert sorted((r.doc_id or 0, r.text) for r in neardup.keep_one_of_each(twice).collect()) == [(0, "q r s"), (2, "a b c d e")]
    assert neardup.keep_one_of_each(docs.limit(0)).count() == 0


def test_pairs_of_a_hub_are_dealt(spark):
    """Pairs that share a row are checked like any other, whichever end it is, and meet copies of its set in parts."""
    from tidemill.llm import neardup

    base = [f"w{i}" for i in range(60)]
    rows = {k: " ".join([*base[: 60 - k % 9], *(f"n{k}x{i}" for i in range(k % 9))]) for k in range(40)}
    docs = spark.createDataFrame([*rows.items(), *rows.items()], "doc_id long, text string").repartition(3)
    nodes = docs.distinct().select(F.col("doc_id").alias("rep"), neardup.text_key("text").alias("tid"))
    pairs = [(min(h, k), max(h, k)) for h in (0, 19) for k in range(40) if k != h] + [(3, 30)]
    pairs = sorted({*pairs})
    sets = {k: shingle_tuples(t) for k, t in rows.items()}
    want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 0 < len(want) < len(pairs)
    for hub_pairs in (4, 256):
        got = neardup.similar(spark.createDataFrame(pairs, "a long, b long"), nodes, docs, "text", 5, 0.8, hub_pairs)
        assert sorted(map(tuple, got.collect())) == want
    assert neardup.similar(spark.createDataFrame([], "a long, b long"), nodes, docs, "text", 5, 0.8).count() == 0


def test_null_and_repeated_ids(spark):
    from tidemill.llm.exact_dedup import exact_dedup, keep_distinct
    from tidemill.llm.langid import known_language
    from tidemill.llm.mixing import mix, mixed_documents

    rows = [(None, "a b"), (1, "ab"), (2, "a b"), (3, "cd"), (3, "cd"), (None, "ef"), (None, "ef"), (4, "gh"), (4, "ij"), (None, "kl")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, None) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    # Of "a b" the smallest id stays among the longest, null last; of rows alike one stays.
    assert got == sorted([(0, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True), (3, 3, 2, False), (0, 0, 2, True), (0, 0, 2, False), (4, 4, 1, True), (4, 4, 1, True), (0, 0, 1, True)])
    assert sorted((r.doc_id or 0, r.text) for r in keep_distinct(docs).collect()) == [(0, "ef"), (0, "kl"), (2, "a b"), (3, "cd"), (4, "gh"), (4, "ij")]
    assert sorted((r.doc_id or 0, r.text) for r in known_language(docs, least=0.0).collect()) == sorted((i or 0, t) for i, t in rows)
    # Rows that repeat the id and text at which the epoch ends are taken whole together.
    taken = sum(-(-r.taken // r["size"]) for r in mix(docs).collect() if r.taken)
    assert taken <= mixed_documents(docs).count() <= taken + 1


def test_lines_brute_force(spark, tmp_path):
    from tidemill.llm.linededup import line_dedup, lines_of, op10_line_dedup, within

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    rows = {r.doc_id: lines_of(r.text) for r in docs.collect()}
    random.seed(3)
    pool = [x for ls in rows.values() for x in ls if x][:110]
    pool += [x[: 3 + k] for k, x in enumerate(y for y in pool if len(y) > 40) if k < 40]
    near = [x[:k] + random.choice("qz ") + x[k + random.randrange(2) :] for x in pool for k in [random.randrange(len(x))]]
    rows |= {900_000 + k: near[k::7] + ["menu", "", "menus"] for k in range(7)}
    first, root = {}, {}
    for i in sorted(rows):
        for pos, x in enumerate(rows[i]):
            if x:
                first.setdefault(x, (i, pos))
    lines = sorted(first, key=first.get)
    for k, x in enumerate(lines):
        root[x] = x
        for y in lines[:k]:
            if within(x, y, min(2, min(len(x), len(y)) // 10)):
                a, b = root[x], root[y]
                if a != b:
                    low, high = sorted((a, b), key=first.get)
                    root = {z: low if r == high else r for z, r in root.items()}
    want = {i: [pos for pos, x in enumerate(ls) if not x or (root[x] == x and first[x] == (i, pos))] for i, ls in rows.items()}
    table = spark.createDataFrame([(i, "\n".join(ls)) for i, ls in rows.items()], "doc_id long, text string").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [int(x) for x in r.kept_lines.split(",") if x] for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want and sum(map(len, want.values())) < sum(map(len, rows.values()))
    assert line_dedup(docs.limit(0)).count() == 0


def test_equal_short_lines(spark, tmp_path):
    from tidemill.llm.linededup import op10_line_dedup

    line = "the quick brown fox jumps over it"
    rows = [(1, f"{line}\nmenu\n\nmenus\n 首页"), (2, f"menu \nx{line}\n\n首页\nlast"), (3, "menu"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.kept_lines) for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (5, 5, "0,1,2,3,4"), 2: (5, 2, "2,4"), 3: (1, 0, ""), 4: (0, 0, "")}


#: Names that operators use inside, as extra columns; repeated rows, null ids, ties, null, empty and very long texts.
CLASH = ["key", "word", "slot", "held", "rep", "h", "row", "copy", "copies", "kept_lines", "n_lines", "tid", "component", "fp", "label", "size", "bucket", "name"]
ODD_ROWS = [(None, "a b"), (1, "ab"), (2, "a b"), (3, "cd"), (3, "cd"), (None, "ef"), (None, None), (None, None), (4, ""), (4, "ij"), (6, "1234 !!"), (7, "word " * 200_000), (7, "word " * 200_000)]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en" if k % 4 else None, "s" if k % 3 else None, *[f"v{k}"] * len(CLASH)) for k, (i, t) in enumerate(ODD_ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def operators():
    from tidemill.llm import bpe, embeddings, exact_dedup, hmm, langid, licenses, linededup, mixing, resample, simhash

    return {
        "op1": lambda d: resample.importance_resample(d, d.select("doc_id"), 0.5),
        "op2": langid.predict_language,
        "op3": exact_dedup.exact_dedup,
        "op4": bpe.encoded_digest,
        "op5": licenses.license_scan,
        "op6": simhash.simhash_groups,
        "op7": mixing.mix,
        "op8": lambda d: hmm.score_texts(d.withColumn("training", F.lit(False)), "training"),
        "op9": lambda d: embeddings.embedding_groups(d.withColumn("embedding", F.expr("case when text is null then null else array(1.0D, double(doc_id)) end")), id_col="doc_id", label_col="lang"),
        "op10": linededup.line_dedup,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows(clashing, name):
    out = operators()[name](clashing)
    column = "vec_id" if name == "op9" else "doc_id"
    assert sorted(r[column] or 0 for r in out.collect()) == sorted(i or 0 for i, _ in ODD_ROWS)
    assert operators()[name](clashing.limit(0)).count() == 0


def test_odd_rows_in_stages(spark, clashing):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:4]:
        out = stage(spark, clashing, SF)
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == clashing.columns and {*rows} <= {tuple(r) for r in clashing.collect()}
        if name == "exact_dedup":
            assert sorted((r[0] or 0, r[1][:5]) for r in rows if r[1]) == [(0, "ef"), (2, "a b"), (3, "cd"), (4, "ij"), (6, "1234 "), (7, "word ")]
        if name == "near_dedup":
            assert sorted((r[0] or 0, (r[1] or "")[:5]) for r in rows) == [(0, "ef"), (1, "ab"), (2, "a b"), (3, "cd"), (4, ""), (4, "ij"), (6, "1234 "), (7, "word ")]
        assert stage(spark, clashing.limit(0), SF).count() == 0
    assert p.STAGES[4][1](spark, clashing, SF).count() == len(ODD_ROWS)


def test_scratch_folder_of_a_plain_session(tmp_path):
    code = "from pyspark.sql import SparkSession; from tidemill.llm.simhash import op6_simhash; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('rows', op6_simhash(s, '/root/testdata/sf0.001').count())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "rows 200" in out.stdout, out.stderr[-2000:]


class Session:
    """As much of a session on a cluster as the folder is asked of."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_no_scratch_folder_on_a_cluster():
    from tidemill.llm.common import scratch_root

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session)
