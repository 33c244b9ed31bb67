"""Whole results of queries: the language model's score, digests of ids and decoded texts, recall at the least cosine."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

SF = "/root/testdata/sf0.001"


def test_bpe_digests_equal_the_library(spark):
    from tokenizers import Tokenizer

    from tidemill.llm.bpe import op4_bpe, vocabulary

    t = Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        decoded = t.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(decoded))


def test_scores_equal_the_plain_forward_recursion(spark, monkeypatch):
    """With the model that the query trains: forward over the symbols of each text, and its words given their symbols."""
    from tidemill.llm import hmm

    kept, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    got = {r.doc_id: r.score for r in hmm.op8_hmm_scores(spark, SF).collect()}
    (start, a, b), _ = kept[0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    words = spark.createDataFrame([(bytearray(w),) for w in {w for ws in tokens.values() for w in ws}], "word binary")
    sym = {bytes(r.word): r.sym for r in words.select("word", hmm.symbol().alias("sym")).collect()}
    total, distinct = defaultdict(int), defaultdict(int)
    for w, c in counts.items():
        total[sym[w]] += c
        distinct[sym[w]] += 1
    for i, ws in tokens.items():
        want = sum(math.log10((counts[w] + 1) / (total[sym[w]] + distinct[sym[w]] + 1)) for w in ws)
        f = None
        for w in ws:
            f = (start if f is None else f @ a) * b[:, sym[w]]
            want += math.log10(f.sum())
            f = f / f.sum()
        assert abs(got[i] - want) <= 1e-7 * max(1.0, abs(want))


def test_planted_neighbours_are_found(spark):
    """Pairs a little over the least cosine, among as many vectors that are like no other."""
    from tidemill.llm.embeddings import embedding_groups

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, 64)))
    y = rng.normal(size=(3000, 64))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    near = 0.931 * x + math.sqrt(1 - 0.931**2) * y
    rows = [(2 * k + j, [float(c) for c in v], "a") for k in range(3000) for j, v in enumerate((x[k], near[k]))]
    rows += [(10_000 + k, [float(c) for c in v], "a") for k, v in enumerate(rng.normal(size=(3000, 64)))]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(6))
    found = got.where("vec_id < 6000 and n_links > 0").count() / 6000
    assert found >= 0.999 and got.where("vec_id >= 10000 and n_links > 0").count() == 0


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    import os

    from tidemill.llm.common import drop_scratch, materialize

    drop_scratch(spark)
    kept = materialize(spark.range(3))
    folder = kept.inputFiles()[0].removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    assert os.path.isdir(f"/{folder}") and drop_scratch(spark) == 1 and not os.path.exists(f"/{folder}") and drop_scratch(spark) == 0


def test_training_in_pieces_equals_training_at_once():
    """Expected counts don't depend on the pieces whose values are held; a long text's memory is that of a piece and its symbols."""
    import tracemalloc

    from tidemill.llm.hmm import begin, expected_counts, time_cuts

    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 41, n).astype("<u2") for n in (1, 1, 2, 7, 40, 40, 333, 1000)]
    model = begin(3, 40)
    want = expected_counts(seqs, *model)
    assert time_cuts(np.array([len(s) for s in seqs]), 1 << 30) == [0, 1000]
    for piece in (1, 2, 5, 100, 1001):
        for x, y in zip(want, expected_counts(seqs, *model, piece=piece), strict=True):
            np.testing.assert_allclose(y, x, rtol=1e-4, atol=1e-5)
    none = expected_counts([np.empty(0, "<u2")], *model)
    assert [float(np.sum(x)) for x in none] == [0.0] * 4
    long = [rng.integers(0, 41, 100_000).astype("<u2")]
    tracemalloc.start()
    expected_counts(long, *model, piece=5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(long[0])


def test_words_of_pieces_are_those_of_the_text():
    from tidemill.llm.hmm import word_pieces

    for text in (None, "", " ", "a", "  Ab \t\x0bc\x1cd ÄB\n", "x" * 30 + " " * 30 + "Y z", "one two three four five six "):
        for size in (1, 3, 8, 1 << 20):
            pieces = list(word_pieces(text, size))
            assert [w for p in pieces for w in p] == [*(text or "").encode().lower().split(), b""]
    assert max(len(p) for p in word_pieces("ab " * 100, 8)) <= 4
