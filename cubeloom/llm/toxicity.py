"""Toxicity by noisy-channel deobfuscation.

Spans that may hide a word (letters mixed with digits or signs, letters spaced
out, letters repeated) become character lattices: each sign may stand for
letters, a run for one or two letters, a separator for nothing or for the end
of a word.  Viterbi decoding under a character trigram model picks the restored
words, which are scored beside the text as written; of letters spaced out, all
words on paths nearly as good as the best are taken, as trigrams alone can't
tell where words end.  Spans without such marks have one path through the
lattice, themselves, and are not decoded.

The score is a noisy-or over learned terms (whole words and word beginnings)
that labelled toxic texts hold and others do not.  The character model counts
the trigrams of all documents, labelled or not.  Terms are fitted on at most
TRAIN_ROWS labelled rows (both classes), of a longer text on one stretch of
TRAIN_CHARS characters at a place its doc_id picks; scoring reads every text whole.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS, TRAIN_CHARS = 6_000, 8_000
#: Distinct trigrams that a task counts before it hands them on, and scores and restored spans that a model remembers.
HELD_TRIGRAMS, HELD_SPANS = 50_000, 20_000
#: A term needs this many toxic texts and this share of them; every toxic text is covered up to COVER times.
LEAST, PRECISION, COVER = 3, 0.95, 4
#: Byte lengths of word beginnings used as terms.
STARTS = (4, 5, 6, 7, 8)
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Words of one letter, as they stand beside spaced words; digits and signs count as such too.
SINGLES = frozenset("aeiouyàèéó0123456789@$!|+")
#: Log costs of the channel.
SUBSTITUTE, COLLAPSE, UNREAD = -1.0, -0.5, -25.0
#: Least log cost of a word of SINGLES, and what a word may lose against the best path.
ALONE, SLACK = -8.0, 8.0

LETTERS = C.byte_table(lambda b: 97 <= b <= 122 or b >= 128)
PLAIN = C.byte_table(lambda b: 97 <= b <= 122)
SIGNS = C.byte_table(lambda b: chr(b) in LEET)
ALNUM = C.byte_table(lambda b: b < 128 and chr(b).isalnum())
#: Separators of spaced letters: white space and punctuation, as bytes (and as first bytes of longer ones) and in a pattern.
GAPS = C.byte_table(lambda b: b < 128 and not chr(b).isalnum() and chr(b) not in LEET)
WIDE_GAPS = C.byte_table(lambda b: b in (0xC2, 0xE2, 0xE3))
_GAP = r"[\x00-\x20\"#%&'()*,\-./:;<=>?\[\\\]^_`{}~\x7f-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\u2000-\u206f\u3000-\u3003]"
SPACED = re.compile(rf"(?<![^\W_])(?:([^\W_]|[@$!|+])\1*{_GAP}+){{2,}}([^\W_]|[@$!|+])\2*(?![^\W_])")
GAP = re.compile(f"{_GAP}+")
RUN = re.compile(r"(?:[^\W_]|[@$!|+])+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
MARK = re.compile(r"[^\W\d_][0-9@$!|+]|[0-9@$!|+][^\W\d_]|([^\W\d_])\1\1")
LONGER = re.compile(r"(.)\1{3,}", re.S)


@functools.cache
def _letter_table() -> np.ndarray:
    """Of each code point, whether it is in [^\\W\\d_]."""
    return np.fromiter(((c := chr(n)).isalnum() and not c.isdecimal() for n in range(0x110000)), bool, 0x110000)


def count_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams packed by 21 bits a letter, counts) over the lower-case words of the texts, with ^ at both ends."""
    x = np.frombuffer(f"  {' '.join(texts).lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letter_table()[x], x, ord("^"))
    seen = np.flatnonzero(np.bincount(x))
    k = len(seen)
    code = np.zeros(seen[-1] + 1, np.int64)
    code[seen] = np.arange(k)
    edge, x = code[ord("^")], code[x]
    one, two, three = x[:-2], x[1:-1], x[2:]
    one = np.where(two == edge, edge, one)
    key = ((one * k + two) * k + three)[(two != edge) | (three != edge)]
    if k**3 <= 1 << 22:
        count = np.bincount(key)
        key = np.flatnonzero(count)
        count = count[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return (seen[key // (k * k)] << 42) | (seen[key // k % k] << 21) | seen[key % k], count


def corpus_trigrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams in order, counts) over all texts; counted in each task first, so the shuffle and the result follow the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["trigram", "n"])

        with C.worker_task(__name__):
            for batch in batches:
                for part, data, offsets in C.text_steps(batch):
                    raw = data.tobytes()
                    key, n = count_trigrams([raw[a:b].decode() for a, b in itertools.pairwise(offsets.tolist())])
                    held.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
                    if len(held) > HELD_TRIGRAMS:
                        yield out()
                        held.clear()
                batch = part = data = offsets = raw = None
                C.release()
            yield out()
            held.clear()

    got = docs.select("text").mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("trigram").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


class CharacterModel:
    """Trigram log probabilities over the letters of words, with ^ at both ends."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray):
        self.three, self.counts = trigrams, counts
        self.two, first = np.unique(trigrams >> 21, return_index=True)
        self.sums = np.add.reduceat(counts, first) if len(first) else counts
        self.size = max(2, len(np.unique(trigrams & 0x1FFFFF)))
        #: Letters from which on the rest of a word tells nothing more.
        self.reach = math.inf
        self.memo: dict[str, float] = {}

    @staticmethod
    def _count(keys: np.ndarray, counts: np.ndarray, key: int) -> int:
        at = int(np.searchsorted(keys, key))
        return int(counts[at]) if at < len(keys) and keys[at] == key else 0

    def score(self, a: str, b: str, c: str) -> float:
        found = self.memo.get(a + b + c)
        if found is None:
            two = ord(a) << 21 | ord(b)
            found = math.log((self._count(self.three, self.counts, two << 21 | ord(c)) + 0.1) / (self._count(self.two, self.sums, two) + 0.1 * self.size))
            if len(self.memo) >= HELD_TRIGRAMS:
                self.memo.clear()
            self.memo[a + b + c] = found
        return found

    def _ways(self, char: str, size: int) -> list[tuple[float, str]]:
        """(cost, letters) of every reading of a run of one character; none for a character without readings."""
        ways = [(UNREAD, "")] if char in LEET else []
        for x in LEET.get(char) or (char if char.isalpha() else ""):
            base = 0.0 if x == char else SUBSTITUTE
            ways += [(base + (COLLAPSE if size > k else 0.0), x * k) for k in sorted({1, min(size, 2)})]
        return ways or [(0.0, "")]

    def _along(self, last: str, text: str) -> tuple[float, str]:
        """Log probability of letters behind a state, and the state after them."""
        total = 0.0
        for x in text:
            total += self.score(last[0], last[1], x)
            last = last[1] + x
        return total, last

    def _moved(self, states: dict, ways: list) -> dict:
        """States (the last two letters) after a run; a path is (last piece, the path before it, letters), so a step costs the same however long the word."""
        new: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, path) in states.items():
            for extra, text in ways:
                gain, a = self._along(last, text)
                total = cost + extra + gain
                if a not in new or total > new[a][0]:
                    new[a] = (total, (text, path, len(text) + (path[2] if path else 0)))
        return new

    def _end(self, states: dict) -> tuple[float, tuple | None]:
        return max(((v[0] + self.score(k[0], k[1], "^"), v[1]) for k, v in states.items()), key=lambda x: x[0])

    def decode(self, span: str) -> str:
        """The best restored word of a span, by Viterbi over its lattice."""
        states = {"^^": (0.0, None)}
        for k, m in enumerate(re.finditer(r"(.)\1*", span, re.S)):
            if k % 2048 == 2047:  # paths as texts, which take less
                states = {a: (c, (_path_text(path), None, path[2])) for a, (c, path) in states.items()}
            states = self._moved(states, self._ways(m[0][0], len(m[0])))
        return _path_text(self._end(states)[1])

    def decode_spaced(self, span: str) -> list[str]:
        """Restored words of a spaced span (one space at each separator): all of it as one word, and each word of
        two letters or more between two separators whose best path through the lattice loses at most SLACK.

        One pass from either end gives the best path through each state; a word only grows over states with a
        path good enough.  Once it has more letters than ``reach``, as many as any term needs to be told, its
        paths so far stand for all longer words, so the work is in proportion to the span.
        """
        parts = span.split(" ")
        n = len(parts)
        whole = self.decode("\n".join(parts))
        if not any(c.isalpha() for c in span):
            return [whole]
        out = set()
        steps = [self._ways(x[0], len(x)) for x in parts]
        single = [ALONE if x in SINGLES else -math.inf for x in parts]
        start = "^^"
        # ahead[i]: the best cost of words that end before letter i; reached[i]: the best cost of each state behind letter i
        ahead, reached = [0.0], []
        for i in range(n):
            states = dict(reached[-1]) if i else {}
            states[start] = max(states.get(start, -math.inf), ahead[i])
            reached.append(self._reach(states, steps[i]))
            end = max(c + self.score(a[0], a[1], "^") for a, c in reached[i].items())
            ahead.append(max(end, ahead[i] + single[i]))
        # behind[i]: the best cost from a word's start at letter i to the end; left[i]: that from each state behind letter i
        behind, left = [-math.inf] * n + [0.0], [{} for _ in range(n)]
        for i in reversed(range(n)):
            left[i] = {a: max(self.score(a[0], a[1], "^") + behind[i + 1], self._onward(a, steps[i + 1], left[i + 1]) if i + 1 < n else -math.inf) for a in reached[i]}
            behind[i] = max(self._onward(start, steps[i], left[i]), single[i] + behind[i + 1])
        least = ahead[n] - SLACK
        for i in range(n):
            if ahead[i] + behind[i] < least:
                continue
            states = {start: (ahead[i], None)}
            for j in range(i, n):
                states = {a: v for a, v in self._moved(states, steps[j]).items() if v[0] + left[j][a] >= least - 1e-9}
                if not states:
                    break
                cost, path = self._end(states)
                if j > i and cost + behind[j + 1] >= least:
                    out.add(_path_text(path))
                if min(v[1][2] for v in states.values()) > self.reach:
                    out.update(_path_text(v[1]) for v in states.values())
                    break
        return [whole, *sorted(out)]

    def _reach(self, states: dict[str, float], ways: list) -> dict[str, float]:
        """The best cost of each state after a run."""
        new: dict[str, float] = {}
        for last, cost in states.items():
            for extra, text in ways:
                gain, a = self._along(last, text)
                if (total := cost + extra + gain) > new.get(a, -math.inf):
                    new[a] = total
        return new

    def _onward(self, last: str, ways: list, left: dict[str, float]) -> float:
        """The best cost from a state over a run to the end."""
        best = -math.inf
        for extra, text in ways:
            gain, a = self._along(last, text)
            best = max(best, extra + gain + left.get(a, -math.inf))
        return best

def _path_text(path: tuple | None) -> str:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def _spaced_texts(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Texts with three letters or signs on their own in a row, between gaps of any length."""
    kind = np.where(gap, 0, data)
    at = np.flatnonzero(gap | (data < 0x80) | (data >= 0xC0))  # further bytes of a character go with its first
    doc = np.searchsorted(offsets, at, side="right") - 1
    fresh = np.concatenate(([True], (kind[at[1:]] != kind[at[:-1]]) | (doc[1:] != doc[:-1])))[: len(at)]
    at, doc = at[fresh], doc[fresh]
    if len(at) < 5:
        return np.zeros(0, np.int64)
    m, g = mark[at] & ~gap[at], gap[at]
    # m, g, m, g, m of one text, and no ASCII letter or digit before the first or behind the last
    open_, other = ~ALNUM[data[at]], doc[1:] != doc[:-1]
    # of signs in a row, the one nearest to the gap may be the first or last
    opens, ends = np.concatenate(([True], open_[:-1] | other)) | open_, np.concatenate((open_[1:] | other, [True])) | open_
    found = m[:-4] & g[1:-3] & m[2:-2] & g[3:-1] & m[4:] & (doc[:-4] == doc[4:]) & opens[:-4] & ends[4:]
    return doc[:-4][found]


def suspect_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a span worth decoding: those with a sign beside a letter on either side or a letter three times, and those with letters spaced out."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter, sign = LETTERS[data], SIGNS[data]
    hits = [np.flatnonzero(letter[:-1] & sign[1:]), np.flatnonzero(sign[:-1] & letter[1:])]
    if n >= 3:
        hits.append(np.flatnonzero(PLAIN[data[2:]] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])))
    for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        first = np.flatnonzero((data >= low) & (data < high))
        for j in range(2 * size):
            first = first[first + j + size < n]
            first = first[data[first + j] == data[first + j + size]]
        hits.append(first)
    marked = np.unique(np.searchsorted(offsets, np.concatenate(hits), side="right") - 1)
    mark, gap = letter | sign, GAPS[data]
    spaced = [_spaced_texts(data, offsets, mark, gap)]
    if WIDE_GAPS[data].any():
        spaced.append(_spaced_texts(data, offsets, mark, gap | WIDE_GAPS[data]))
    return marked, np.unique(np.concatenate(spaced))


def restored(text: str, decode, decode_spaced, marked: bool = True, spaced: bool = True) -> list[str]:
    """Restored words of a lower-case text's suspect spans."""
    out = []
    if spaced:
        out = [w for m in SPACED.finditer(text) for w in decode_spaced(GAP.sub(" ", LONGER.sub(r"\1\1\1", m[0])))]
    at = 0
    while marked and (m := MARK.search(text, at)):
        begin = m.start()
        while begin > at and RUN.match(text[begin - 1]):
            begin -= 1
        run = RUN.match(text, begin)
        at = run.end()
        s = LONGER.sub(r"\1\1\1", run[0])
        out.append(decode(s))
        if (core := s.rstrip("!|+$@")) != s:
            out.append(decode(core) if MARK.search(core) else core)
    return out


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words and word beginnings; ``data`` is lower-case."""
    starts, ends, doc = C.split_words(data, offsets, LETTERS)
    size = ends - starts
    keys, docs = [C.hash_spans(data, starts, ends)], [doc]
    for k in STARTS:
        of = np.flatnonzero(size > k)
        with np.errstate(over="ignore"):
            keys.append(C.mix(C.hash_spans(data, starts[of], starts[of] + k) + C.U64(k)))
        docs.append(doc[of])
    return np.concatenate(keys), np.concatenate(docs)


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return C.lower_ascii(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def _remembered(decode):
    """Restored words of short spans are kept."""
    short = functools.lru_cache(HELD_SPANS)(decode)
    return lambda span: short(span) if len(span) <= 64 else decode(span)


class ToxicityModel:
    """Learned terms (sorted hashes and their weights) and the character model."""

    def __init__(self, texts: list[str], toxic: list[int], characters: CharacterModel):
        self.characters = characters
        self._remember()
        both = {t: int(x) for t, x in zip(texts, toxic, strict=True)}  # copies count once
        bad = [t for t, x in both.items() if x]
        good = [t for t, x in both.items() if not x]
        self.base = (len(bad) + 0.5) / (len(both) + 1)
        self.keys, self.weights = np.zeros(0, C.U64), np.zeros(0)
        if bad:
            self._learn(bad, good)

    def _remember(self) -> None:
        self.decode, self.decode_spaced = _remembered(self.characters.decode), _remembered(self.characters.decode_spaced)

    def _learn(self, bad: list[str], good: list[str]) -> None:
        key, doc = term_hashes(*_packed(bad))
        pair = np.unique(np.stack([key, doc.astype(C.U64)], axis=1), axis=0)
        names, term, count = np.unique(pair[:, 0], return_inverse=True, return_counts=True)
        wrong = np.zeros(len(names), np.int64)
        for at in range(0, len(good), 200):
            k, d = term_hashes(*_packed(good[at : at + 200]))
            pos = np.minimum(np.searchsorted(names, k), len(names) - 1)
            ok = names[pos] == k
            wrong += np.bincount(np.unique(pos[ok] * 200 + d[ok]) // 200, minlength=len(names))
        usable = (count >= LEAST) & (count >= PRECISION * (count + wrong))
        doc = pair[:, 1].astype(np.int64)
        keep = usable[term]
        term, doc = term[keep], doc[keep]
        need = np.full(len(bad), COVER)
        by_term = np.argsort(term, kind="stable")
        first, last = np.searchsorted(term[by_term], np.arange(len(names))), np.searchsorted(term[by_term], np.arange(len(names)), side="right")
        live, chosen = usable.copy(), []
        while True:
            gain = np.where(live, np.bincount(term, need[doc] > 0, len(names)) - 3.0 * wrong, -1)
            best = int(gain.argmax())
            if gain[best] < LEAST:
                break
            held = doc[by_term[first[best] : last[best]]]
            chosen.append(best)
            # terms of nearly the same texts say the same
            inside = np.zeros(len(bad), bool)
            inside[held] = True
            same = np.bincount(term, inside[doc], len(names))
            live &= ~((same >= 0.9 * count) & (same >= 0.9 * len(held)))
            live[best] = False
            need[held] -= 1
        chosen = np.array(sorted(chosen, key=lambda c: names[c]), np.int64)
        self.keys = names[chosen]
        # a longer word than every term is told by its beginning
        data, offsets = _packed(bad)
        starts, ends, _ = C.split_words(data, offsets, LETTERS)
        terms = np.isin(C.hash_spans(data, starts, ends), self.keys)
        self.characters.reach = max([*STARTS, *(ends - starts)[terms].tolist()])
        self.weights = (count[chosen] + 2 * self.base) / (count[chosen] + wrong[chosen] + 2)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text: noisy-or over the distinct terms it holds, as written or restored."""
        n = len(offsets) - 1
        out = np.full(n, min(self.base, 0.5) * 0.2)
        if not len(self.keys):
            return out
        data = C.lower_ascii(data)
        raw = data.tobytes()
        hits = [self._hits(data, offsets)]
        marked, spaced = (set(x.tolist()) for x in suspect_texts(data, offsets))
        of = np.array(sorted(marked | spaced), np.int64)
        if len(of):
            words = ["\n".join(restored(raw[offsets[i] : offsets[i + 1]].decode().lower(), self.decode, self.decode_spaced, i in marked, i in spaced)) for i in of.tolist()]
            k, d = self._hits(*_packed(words))
            hits.append((k, of[d]))
        k, d = (np.concatenate(x) for x in zip(*hits, strict=True))
        pair = np.unique(d * len(self.keys) + k)
        miss = np.bincount(pair // len(self.keys), np.log1p(-self.weights[pair % len(self.keys)]), n)
        return np.where(miss < 0, np.maximum(out, 1 - np.exp(miss)), out)

    def _hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, doc = term_hashes(data, offsets)
        pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[pos] == key
        return pos[ok], doc[ok]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("decode", "decode_spaced")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._remember()


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, rows: int = TRAIN_ROWS, size: int = TRAIN_CHARS) -> ToxicityModel | None:
    """A model from labelled rows outside the held-out fold; none without such rows."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.select("doc_id", "text")
    usable = F.col("text").isNotNull() & (C.crc_mod("doc_id", fold) != held)
    chosen = C.bounded_sample(docs, usable, rows, 7, marks)
    # one text a doc_id, however often it is repeated
    got = docs.where(usable).join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min(C.stretch("text", "doc_id", size)).alias("text")).collect()
    got.sort(key=lambda r: (r.h, r.doc_id))
    return ToxicityModel([r.text for r in got], [r.toxic for r in got], CharacterModel(*corpus_trigrams(docs))) if got else None


def scan(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Columns c0.. of ``docs``, then x0 the score.  Null and empty texts get the score of a text without terms;
    without labelled rows every score is 0.  Very long texts are scored whole; other columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(part, data, offsets):
            return [pa.array(np.zeros(len(offsets) - 1) if m is None else m.scores(data, offsets), pa.float64())]

        return step

    return C.append_columns(docs, make, "double")


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row; repeated rows get equal scores, an empty table none.

    A null doc_id keeps its row and counts as an empty one for its fold; see ``scan`` for texts.
    """
    model = model or train(docs, labels)
    docs = docs.select("doc_id", "text")
    found = scan(docs, model)
    return C.pick(found, docs, ["doc_id"], held_out=C.crc_mod("c0", 3) == 1, score="x0", predicted=(F.col("x0") >= limit).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``, with all columns; repeated rows stay or go together,
    null and empty texts stay, without labelled rows all do; an empty table stays empty."""
    found = scan(docs, train(docs, labels))
    return C.pick(found.where(f"x0 < {limit}"), docs, docs.columns)
