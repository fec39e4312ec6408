import itertools
import random
import re

import pytest

from cubeloom.llm import common, toxicity

RND = random.Random(5)
VOCAB = [a + b for a in "bcdfgjklm" for b in ("a", "e", "ion", "our")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(3)
    texts = [prose(40, rnd) for _ in range(200)]
    texts[:60] = [f"{t} {w} {prose(5, rnd)}" for t, w in zip(texts, ["loser", "moron", "scum", "idiot", "fag", "connard"] * 10, strict=False)]
    return toxicity.ToxicityModel(texts, [1] * 60 + [0] * 140, toxicity.CharacterModel(*toxicity.count_trigrams(texts)))


def word_cost(m, text):
    a, total = "^^", 0.0
    for x in text + "^":
        total += m.score(a[0], a[1], x)
        a = a[1] + x
    return total


def readings(char, size):
    """All readings of a run by the definition of the channel."""
    out = [(toxicity.UNREAD, "")] if char in toxicity.LEET else []
    for x in toxicity.LEET.get(char) or (char if char.isalpha() else ""):
        for k in {1, min(size, 2)}:
            out.append(((0.0 if x == char else toxicity.SUBSTITUTE) + (toxicity.COLLAPSE if size > k else 0.0), x * k))
    return out or [(0.0, "")]


def test_decoder_against_all_paths(model):
    """Viterbi finds the best of all paths of the lattice."""
    m, rnd = model.characters, random.Random(1)
    for _ in range(300):
        span = "".join(rnd.choice("aelosrm013$@!+") * rnd.choice([1, 1, 1, 2, 3]) for _ in range(rnd.randrange(1, 6)))
        runs = [x[0] for x in re.finditer(r"(.)\1*", span)]
        paths = [(sum(c for c, _ in p) + word_cost(m, "".join(t for _, t in p)), "".join(t for _, t in p)) for p in itertools.product(*[readings(r[0], len(r)) for r in runs])]
        best = max(c for c, _ in paths)
        got = m.decode(span)
        assert max(c for c, t in paths if t == got) == pytest.approx(best)


def test_spaced_decoder_against_all_segmentations(model):
    """All words of two letters or more on paths that lose at most SLACK, by enumeration of every segmentation."""
    m, rnd = toxicity.CharacterModel(model.characters.three, model.characters.counts), random.Random(2)
    for _ in range(120):
        parts = [rnd.choice(["l", "o", "s", "e", "r", "a", "0", "$", "ss", "m", "é"]) for _ in range(rnd.randrange(3, 8))]
        n = len(parts)

        def best(i, j, parts=parts):
            """(cost, text) of the best reading of letters i..j as one word."""
            return max((sum(c for c, _ in p) + word_cost(m, "".join(t for _, t in p)), "".join(t for _, t in p)) for p in itertools.product(*[readings(x[0], len(x)) for x in parts[i:j]]))

        word = {(i, j): best(i, j) for i in range(n) for j in range(i + 1, n + 1)}
        for i in range(n):
            if parts[i] in toxicity.SINGLES:
                word[i, i + 1] = (max(word[i, i + 1][0], toxicity.ALONE), "")
        through = {}
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
            ends = [0, *cuts, n]
            total = sum(word[a, b][0] for a, b in itertools.pairwise(ends))
            for a, b in itertools.pairwise(ends):
                through[a, b] = max(through.get((a, b), -1e9), total)
        top = max(through.values())
        want = {word[i, j][1] for (i, j), c in through.items() if j - i > 1 and c >= top - toxicity.SLACK}
        if any(abs(c - (top - toxicity.SLACK)) < 1e-6 for c in through.values()):
            continue
        got = m.decode_spaced(" ".join(parts))
        assert set(got[1:]) == want


def scores(model, texts):
    return [x > 0.7 for x in model.scores(*toxicity._packed(texts))]


def test_long_spans(model):
    """Spans of hundreds of letters are one word, spaced or not."""
    word = "loser" + "abeion" * 20
    assert scores(model, [" ".join(word), "l" + "o" * 100 + "ser", "l0" + "s" * 90 + "er"]) == [True] * 3
    assert word in toxicity.restored("l0ser" + "abeion" * 20, model.decode, model.decode_spaced)
    assert word in toxicity.restored(" ".join(word), model.decode, model.decode_spaced)
    assert len(model.decode("ab0" * 40)) == 120
    assert scores(model, ["x " * 3000, " ".join("bcdfg" * 400)]) == [False, False]


def test_repeated_single_letters_stay_in_proportion(model):
    """Spans whose segmentations are all alike: few words, and the same hits as without the stop."""
    free = toxicity.CharacterModel(model.characters.three, model.characters.counts)
    for span in ["a " * 2000, "l o s e r " * 300, "a b i o n " * 200, "é " * 500]:
        got = model.characters.decode_spaced(span.strip())
        assert sum(map(len, got)) < 60 * len(span)
        short = span[:90].strip()
        hits = lambda words: set(model._hits(*toxicity._packed(["\n".join(words)]))[0].tolist())
        assert hits(model.characters.decode_spaced(short)) == hits(free.decode_spaced(short))
    assert model.characters.reach < 20 and len(free.decode("ab0c" * 30_000)) == 120_000


def test_long_texts_are_sampled(spark):
    """A long labelled text takes part by a stretch of it; short ones whole."""
    long = "".join(chr(97 + k % 26) for k in range(500))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, ""), (4, long[:100]), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.x for r in df.select("doc_id", common.stretch("text", "doc_id", 100).alias("x")).collect()}
    assert len(got[1]) == 100 and got[1] in long and got[2] == "short" and got[3] == "" and got[4] == long[:100] and got[5] is None
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(df, labels, held=9, size=100) is not None


def test_remove_toxic_against_plain_scores(spark, model, monkeypatch):
    """The stage keeps exactly the rows whose plain score is under the limit."""
    texts = ["you loser", "fine words here", None, "", "what a m0r0n", "s c u m", "great!", "you loser"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, x0 string")
    monkeypatch.setattr(toxicity, "train", lambda d, m: model)
    kept = toxicity.remove_toxic(df, None)
    want = [i for i, t in enumerate(texts) if model.scores(*toxicity._packed([t or ""]))[0] < 0.7]
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want == [1, 2, 3, 6]
