"""Language ID by a linear-chain conditional random field.

Words are labelled with languages: affixes, byte trigrams and the word itself
(the lexicon) score each label, learned transitions join neighbours, and
forward-backward gives each word's posterior, so a text that switches language
is counted word by word.  A document's language is the label with the largest
posterior mass.

The model is fitted on the driver on at most TRAIN_ROWS labelled documents, of a
longer text on one stretch of TRAIN_CHARS characters at a place its doc_id picks.
Beside them stand spliced texts, stretches of two languages in turn, so that the
transitions see words change their language.  Prediction reads every text whole,
and a sentence is one chain however long it is.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS, TRAIN_CHARS = 1_500, 8_000
#: Buckets of hashed features, and words in one matrix of chains (or one chain).
BUCKETS, MATRIX = 1 << 15, 1 << 17
#: Spliced texts for each labelled one, and words of a stretch.
SPLICED, STRETCH = 0.3, (2, 10)
AFFIXES = (1, 2, 3, 4)
LETTERS = C.byte_table(lambda b: 97 <= b <= 122 or b >= 128)
STOPS = C.byte_table(lambda b: b in b".!?\n")


class Words:
    """Words of some texts, their features and their sequences."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = C.lower_ascii(data)
        starts, ends, self.doc = C.split_words(data, offsets, LETTERS)
        self.n = len(starts)
        size = ends - starts
        ids = []
        with np.errstate(over="ignore"):
            for salt, (a, b, has) in enumerate([(starts, ends, size > 0), *[(starts, np.minimum(starts + k, ends), size > k) for k in AFFIXES], *[(np.maximum(ends - k, starts), ends, size > k) for k in AFFIXES]]):
                h = C.mix(C.hash_spans(data, a, b) + C.U64(salt * 7919)) % C.U64(BUCKETS) if self.n else np.zeros(0, C.U64)
                ids.append(np.where(has, h.astype(np.int64), BUCKETS))
        self.features = np.stack(ids, axis=1) if self.n else np.zeros((0, 1 + 2 * len(AFFIXES)), np.int64)
        d = data.astype(np.uint32)
        with np.errstate(over="ignore"):
            gram = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) if len(d) > 2 else np.zeros(0, np.uint32)
            self.grams = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1)
        self.end = ends
        self.gram_from, self.gram_to = starts, np.maximum(ends - 2, starts)
        stop = np.concatenate(([0], np.cumsum(STOPS[data])))
        first = np.ones(self.n, bool)
        if self.n:
            first[1:] = (self.doc[1:] != self.doc[:-1]) | (stop[starts[1:]] > stop[ends[:-1]])
        self.begin = np.flatnonzero(first)
        self.length = np.diff(np.append(self.begin, self.n))

    def chains(self):
        """(word index, mask) matrices of sentences of similar length."""
        low, high = 0, 4
        while low < self.length.max(initial=0):
            of = np.flatnonzero((self.length > low) & (self.length <= high))
            low, high, rows = high, 2 * high, max(1, MATRIX // high)
            for at in range(0, len(of), rows):
                part = of[at : at + rows]
                steps = np.arange(self.length[part].max())
                mask = steps < self.length[part][:, None]
                yield np.where(mask, self.begin[part][:, None] + steps, 0), mask


class ChainField:
    """The conditional random field: weights of features and grams, transitions, and start scores."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.w = np.zeros((BUCKETS + 1, n), np.float32)
        self.g = np.zeros((BUCKETS, n), np.float32)
        self.trans = np.zeros((n, n))
        self.start = np.zeros(n)

    def scores(self, words: Words) -> np.ndarray:
        out = self.w[words.features].sum(axis=1, dtype=np.float64)
        sums = np.zeros((len(words.grams) + 3, len(self.labels)))
        np.cumsum(self.g[words.grams], axis=0, dtype=np.float64, out=sums[1 : len(words.grams) + 1])
        sums[len(words.grams) + 1 :] = sums[len(words.grams)]
        return out + sums[words.gram_to] - sums[words.gram_from]

    def marginals(self, words: Words, pairs: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each word's labels by forward-backward; adds expected transitions to ``pairs``."""
        scores = self.scores(words)
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) if words.n else scores
        out = np.zeros_like(e)
        step = np.exp(self.trans)
        for index, mask in words.chains():
            em = e[index]
            s, t, n = em.shape
            ahead = np.empty((s, t, n))
            ahead[:, 0] = np.exp(self.start) * em[:, 0]
            ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
            for i in range(1, t):
                a = (ahead[:, i - 1] @ step) * em[:, i]
                a /= a.sum(axis=1, keepdims=True)
                ahead[:, i] = np.where(mask[:, i : i + 1], a, ahead[:, i - 1])
            back = np.ones((s, n))
            post = np.empty((s, t, n))
            for i in range(t - 1, -1, -1):
                p = ahead[:, i] * back
                post[:, i] = p / p.sum(axis=1, keepdims=True)
                if i:
                    right = em[:, i] * back
                    if pairs is not None:
                        joint = ahead[:, i - 1][:, :, None] * step * right[:, None, :]
                        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True))[mask[:, i]].sum(axis=0)
                    b = right @ step.T
                    back = np.where(mask[:, i : i + 1], b / b.sum(axis=1, keepdims=True), back)
            out[index[mask]] = post[mask]
            if starts is not None:
                starts += post[:, 0].sum(axis=0)
        return out

    def fit(self, texts: list[str], langs: list[str], rounds: int = 4, rate: float = 0.25, seed: int = 0) -> ChainField:
        """Stochastic gradient of the conditional likelihood (AdaGrad); every word has its document's label, in spliced texts its stretch's."""
        at = {k: i for i, k in enumerate(self.labels)}
        n = len(self.labels)
        rnd = np.random.default_rng(seed)
        order = rnd.permutation(len(texts))
        batches = []
        for part in np.array_split(order, max(1, len(order) // 50)):
            held = [[(texts[i].encode(), at[langs[i]])] for i in part]
            held += [p for p in (spliced(rnd, texts, langs, at) for _ in range(int(SPLICED * len(part)) if n > 1 else 0)) if p]
            pieces = [p for x in held for p in x]
            size = np.array([len(r) for r, _ in pieces])
            starts = np.cumsum(size) - size
            ends = np.cumsum([sum(len(r) for r, _ in x) for x in held])
            words = Words(np.frombuffer(b"".join(r for r, _ in pieces), np.uint8), np.concatenate(([0], ends)).astype(np.int64))
            batches.append((words, np.array([k for _, k in pieces])[np.searchsorted(starts, words.gram_from, side="right") - 1] if words.n else np.zeros(0, np.int64)))
        seen = [np.full_like(x, 1e-2) for x in (self.w, self.g, self.trans, self.start)]
        for _ in range(rounds):
            for words, gold in batches:
                if not words.n:
                    continue
                pairs, starts = np.zeros((n, n)), np.zeros(n)
                delta = -self.marginals(words, pairs, starts)
                delta[np.arange(words.n), gold] += 1
                first = np.zeros(words.n, bool)
                first[words.begin] = True
                real = np.zeros((n, n))
                np.add.at(real, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
                grams = words.gram_to - words.gram_from
                where = np.repeat(words.gram_from, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
                spread = np.repeat(delta, grams, axis=0)
                gw = np.stack([np.bincount(words.features.ravel(), np.repeat(delta[:, k], words.features.shape[1]), BUCKETS + 1) for k in range(n)], axis=1)
                gg = np.stack([np.bincount(words.grams[where], spread[:, k], BUCKETS) for k in range(n)], axis=1)
                gw[BUCKETS] = 0
                norm = words.n
                for x, g, s in zip((self.w, self.g, self.trans, self.start), (gw / norm * 50, gg / norm * 50, (real - pairs) / norm, (np.bincount(gold[words.begin], minlength=n) - starts) / norm), seen, strict=True):
                    s += g * g
                    x += (rate * g / np.sqrt(s)).astype(x.dtype)
        return self


def spliced(rnd: np.random.Generator, texts: list[str], langs: list[str], at: dict[str, int]) -> list[tuple[bytes, int]]:
    """One sentence of stretches of two labelled texts in turn, as (bytes, label) pieces; none if the two share a label or are short."""
    two = rnd.integers(0, len(texts), 2)
    words = [re.split(r"[\s.!?]+", texts[i]) for i in two]
    if langs[two[0]] == langs[two[1]] or min(map(len, words)) < 4 * STRETCH[1]:
        return []
    out = []
    for k in range(4):
        n = int(rnd.integers(STRETCH[0], STRETCH[1] + 1))
        a = int(rnd.integers(0, len(words[k % 2]) - n))
        out.append(((" ".join(words[k % 2][a : a + n]) + " ").encode(), at[langs[two[k % 2]]]))
    return out


def train(docs: DataFrame, fold: int = 4, held: int = 2, rows: int = TRAIN_ROWS, size: int = TRAIN_CHARS) -> ChainField | None:
    """A field from text and non-null lang of documents outside the held-out fold; none without such rows."""
    docs = docs.select("doc_id", "text", "lang")
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.crc_mod("doc_id", fold) != held)
    chosen = C.bounded_sample(docs, usable, rows, 6)
    # one text a doc_id, however often it is repeated
    got = docs.where(usable).join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id").agg(F.min(F.struct(C.stretch("text", "doc_id", size).alias("text"), "lang")).alias("d")).select("h", "doc_id", "d.*").collect()
    got.sort(key=lambda r: (r.h, r.doc_id))
    return ChainField(sorted({r.lang for r in got})).fit([r.text for r in got], [r.lang for r in got]) if got else None


def scan(docs: DataFrame, model: ChainField | None) -> DataFrame:
    """Columns c0.. of ``docs``, then x0 language and x1 its share of the posterior mass (0 to 1).

    ``und`` with score 0 if a text is null, empty or without a letter, or if
    nothing was learned.  Very long texts are read whole, repeated rows get equal
    results, an empty table gives none; other columns are never read and stay,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        field = shared.value

        def step(part, data, offsets):
            n = len(offsets) - 1
            raw = data.tobytes()
            if field is None:
                return [pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64())]
            words = Words(data, offsets)
            post = field.marginals(words)
            mass = np.stack([np.bincount(words.doc, post[:, k], n) for k in range(len(field.labels))], axis=1) if words.n else np.zeros((n, len(field.labels)))
            total, best = mass.sum(axis=1), mass.argmax(axis=1)
            langs, scores = [], []
            for i in range(n):
                ok = total[i] > 0 and any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].decode()))
                langs.append(field.labels[best[i]] if ok else "und")
                scores.append(min(1.0, float(mass[i, best[i]] / total[i])) if ok else 0.0)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return step

    return C.append_columns(docs, make, "string, double")


def language_id(docs: DataFrame, model: ChainField | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a null doc_id counts as an empty one for its fold; see ``scan`` for texts."""
    model = model or train(docs)
    docs = docs.select("doc_id", "text")
    found = scan(docs, model)
    return C.pick(found, docs, ["doc_id"], held_out=C.crc_mod("c0", 4) == 2, lang_pred="x0", score="x1")


def language_spans(docs: DataFrame, model: ChainField | None = None) -> DataFrame:
    """doc_id and spans of every row: (start, end, lang) in UTF-8 bytes of runs of words with one most likely language.

    Texts without a word, or null, have no spans, as has every text if nothing was learned.
    """
    model = model or train(docs)
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        field = shared.value

        def step(part, data, offsets):
            n = len(offsets) - 1
            spans: list[list[dict]] = [[] for _ in range(n)]
            words = Words(data, offsets)
            if field is not None and words.n:
                best = field.marginals(words).argmax(axis=1)
                new = np.concatenate(([True], (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1])))
                first = np.flatnonzero(new)
                for a, b in itertools.pairwise([*first.tolist(), words.n]):
                    d = int(words.doc[a])
                    spans[d].append({"start": int(words.gram_from[a] - offsets[d]), "end": int(words.end[b - 1] - offsets[d]), "lang": field.labels[best[a]]})
            return [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))]

        return step

    return C.pick(C.append_columns(docs, make, ["array<struct<start:long,end:long,lang:string>>"]), docs, ["doc_id"], spans="x0")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` with a language, with all columns; ``und`` goes, and so do texts where no label has ``least`` of the mass.

    Without any labelled text nothing can be told, and every row stays.
    Repeated rows stay or go together; an empty table stays empty.
    """
    model = train(docs)
    if model is None:
        return docs
    found = scan(docs, model)
    return C.pick(found.where(f"x0 <> 'und' and x1 >= {least}"), docs, docs.columns)
