import collections, re, random
import pytest
from cubeloom.llm import common, decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_longest(docs, items, window=13):
    """By trying every place of every item at every place of every document: n_hit, items, longest (words, word, item)."""
    out = {}
    for i, t in docs:
        w, hit, ids, best = words_of(t), set(), set(), (0, None, None)
        for name, x in sorted(items, key=lambda x: (x[0] is None, x)):
            x = words_of(x)
            for q in range(len(x)):
                for p in range(len(w)):
                    n = 0
                    while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                        n += 1
                    if n >= window or (q == 0 and n == len(x)):
                        hit.update(range(p, p + (window if n >= window else n)))
                        ids.add(name)
                        if n > best[0] or (n == best[0] and p < best[1]):
                            best = (n, p, name)
        out[i] = (len(w), len(hit), sorted(ids - {None}), *best)
    return out


def test_longest_matches_and_removal(spark, monkeypatch):
    """Small alphabets, so that words repeat inside matches; long items, short ones, equal ones, several parts."""
    rnd = random.Random(4)
    say = lambda n, k: " ".join(rnd.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(str(k), say(rnd.choice([15, 20, 40]), 4)) for k in range(8)] + [("s1", "zz yy xx"), ("s2", "zz yy xx"), (None, say(18, 4)), ("n", None), ("e", "...")]
    texts = []
    for k in range(60):
        x = words_of(rnd.choice(items)[1] or "")
        a = rnd.randrange(max(1, len(x)))
        texts.append(say(rnd.randrange(20), 5) + " " + " ".join(x[a : a + rnd.randrange(1, 40)]) + " " + say(rnd.randrange(20), 5))
    texts += [None, "", "  ", "zz yy xx", "q " * 500 + "zz yy xx", "q " * 3000 + " ".join(words_of(items[0][1])[:15]), "q " * 50 + " ".join(words_of(items[0][1])[:12])]
    docs = list(enumerate(texts))
    want = plain_longest(docs, items)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, x3 string, c0 int").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (decontamination.PART_BYTES, 150):
        monkeypatch.setattr(decontamination, "PART_BYTES", size)
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.longest_words, r.longest_start) for r in decontamination.decontamination(df, bench).collect()}
        assert got == {i: v[:5] for i, v in want.items()}
        kept = decontamination.remove_contaminated(df, bench)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, (n, h, _, m, *_) in want.items() if not (m >= 13 or (h and 20 * h >= n))}
    monkeypatch.undo()
    assert {r.doc_id: r.longest_item for r in decontamination.decontamination(df, bench).collect()} == {i: v[5] for i, v in want.items()}
    long = len(texts) - 2  # one passage of 15 words in 3,000
    assert want[long][3] == 15 and 20 * want[long][1] < want[long][0] and want[long + 1][3] == 0
    found = {(r.item_id, r.start): (r.length, r.doc_id) for r in decontamination.longest_matches(df, bench).collect()}
    for name, x in items:
        x = words_of(x) if name else []
        for q in range(len(x)):
            best = (1, 0)
            for i, t in docs:
                w = words_of(t)
                for p in range(len(w)):
                    n = 0
                    while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                        n += 1
                    best = max(best, (n, -i))
            assert found.get((name, q)) == ((best[0], -best[1]) if best[0] > 1 else None)
