import itertools
import random

import numpy as np
import pytest

from cubeloom.llm import common, language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field():
    out = language_id.ChainField(["a", "b", "c"])
    rnd = np.random.default_rng(3)
    out.w[:], out.g[:] = rnd.normal(size=out.w.shape), rnd.normal(size=out.g.shape)
    out.w[language_id.BUCKETS] = 0
    out.trans[:], out.start[:] = rnd.normal(size=(3, 3)), rnd.normal(size=3)
    return out


def plain_marginals(field, score):
    """Forward-backward of one chain, word by word, in logs."""
    n, k = score.shape
    ahead, behind = np.zeros((n, k)), np.zeros((n, k))
    ahead[0] = field.start + score[0]
    for i in range(1, n):
        ahead[i] = score[i] + [np.logaddexp.reduce(ahead[i - 1] + field.trans[:, q]) for q in range(k)]
    for i in range(n - 2, -1, -1):
        behind[i] = [np.logaddexp.reduce(field.trans[p] + score[i + 1] + behind[i + 1]) for p in range(k)]
    post = np.exp(ahead + behind - np.logaddexp.reduce(ahead[0] + behind[0]))
    return post / post.sum(axis=1, keepdims=True)


def words_of(*texts):
    raw = [t.encode() for t in texts]
    return language_id.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))


def test_long_sentences_are_one_chain(field):
    """500 and 3,000 words without a stop beside short sentences: every posterior is that of one whole chain."""
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(n))
    texts = [say(500), say(3), say(65) + ". " + say(64), "", say(3000), say(1)]
    words = words_of(*texts)
    assert sorted(words.length.tolist()) == sorted([500, 3, 65, 64, 3000, 1])
    score, post = field.scores(words), field.marginals(words)
    for a, n in zip(words.begin, words.length, strict=True):
        assert np.allclose(post[a : a + n], plain_marginals(field, score[a : a + n]), atol=1e-7)


def test_transitions_of_gold_labels_and_gradient():
    """Spliced texts hold both labels in one chain."""
    rnd = np.random.default_rng(0)
    texts, langs = [" ".join(["ab"] * 60), " ".join(["xy"] * 60)], ["a", "b"]
    got = [p for p in (language_id.spliced(rnd, texts, langs, {"a": 0, "b": 1}) for _ in range(20)) if p]
    assert got and all([k for _, k in p] in ([0, 1, 0, 1], [1, 0, 1, 0]) for p in got)
    for p in got:
        words = words_of("".join(r.decode() for r, _ in p))
        assert len(words.begin) == 1
    field = language_id.ChainField(["a", "b"]).fit(texts * 30, langs * 30)
    assert (field.trans[0, 1] < field.trans[0, 0]) and (field.trans[1, 0] < field.trans[1, 1])


def test_code_switched_text(spark):
    """Held-out texts of two languages in one sentence: words get the language of their stretch."""
    docs = common.documents(spark, SF)
    model = language_id.train(docs)
    rows = docs.where("lang is not null and length(text) > 400").withColumn("m", common.crc_mod("doc_id", 4)).where("m = 2").select("text", "lang").limit(60).collect()
    rnd, right, total = random.Random(1), 0, 0
    for _ in range(60):
        a, b = rnd.sample(rows, 2)
        if a.lang == b.lang:
            continue
        parts = [(x.lang, " ".join(x.text.replace(".", " ").replace("!", " ").replace("?", " ").split()[k : k + 12])) for x, k in ((a, 5), (b, 5), (a, 17))]
        text = " ".join(t for _, t in parts)
        words = words_of(text)
        best = model.marginals(words).argmax(axis=1)
        ends = list(itertools.accumulate(len(t.encode()) + 1 for _, t in parts))
        gold = [parts[int(np.searchsorted(ends, s, side="right"))][0] for s in words.gram_from]
        right += sum(model.labels[i] == g for i, g in zip(best, gold, strict=True))
        total += len(gold)
    assert total > 500 and right / total > 0.85
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 ..")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in language_id.language_spans(df, model).collect()}
    raw = text.encode()
    assert spans[2] == [] == spans[3] and spans[1][0].start == 0 and spans[1][-1].end == len(raw.rstrip(b" ,"))
    assert all(x.end < y.start and x.lang != y.lang for x, y in itertools.pairwise(spans[1]))


def test_keep_known_against_plain_rule(spark, monkeypatch):
    docs = common.documents(spark, SF).limit(200)
    model = language_id.train(common.documents(spark, SF))
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "", "en", "s", 0), (-3, "12 34 !!", "en", "s", 8)], docs.schema)
    both = docs.unionByName(odd).cache()
    monkeypatch.setattr(language_id, "train", lambda d: model)
    kept = language_id.keep_known(both)
    want = set()
    for r in both.collect():
        words = words_of(r.text or "")
        mass = model.marginals(words).sum(axis=0) if words.n else np.zeros(1)
        if words.n and any(map(str.isalpha, r.text)) and mass.max() / mass.sum() >= 0.4:
            want.add(r.doc_id)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and -1 not in want
    monkeypatch.setattr(language_id, "train", lambda d: None)
    assert language_id.keep_known(both).count() == both.count()  # nothing learned, nothing rejected
