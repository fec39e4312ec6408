"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard (a slice of documents) gets a suffix array over its words.  Every
suffix of every benchmark item is binary-searched in it: the neighbours of its
place give the longest verbatim match and its location, and the suffixes that
share a whole window with it are all the occurrences of that window.  Documents
with such a match are affected.

Suffixes are ranked by doubling: ranks of 1, 2, 4, ... words, which sort them to
any depth and give the common length of two suffixes in a few steps.  Only words
that lie in a run of pairs which both sides hold, as long as the shortest thing
to find, are ranked; nothing shorter can hold a match.

The benchmark side comes to the driver in parts of at most PART_BYTES of text,
one at a time; each part is a pass over the documents, and a table in the shared
folder stands between passes, so neither driver nor workers ever hold two parts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: Stands for a null doc_id while ties are resolved.
NO_ID = np.iinfo(np.int64).max
#: Benchmark text that one pass holds.
PART_BYTES = 32 << 20
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, letters, anything beyond ASCII.
ALNUM_WORDS = C.byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word."""
    data = C.lower_ascii(data)
    starts, ends, doc = C.split_words(data, offsets, ALNUM_WORDS)
    return C.hash_spans(data, starts, ends), doc


def _parted(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in one array with a 0 between owners and at the end, and the place of each word."""
    place = np.arange(len(ids)) + owner
    flat = np.zeros(int(place[-1]) + 2 if len(ids) else 1, np.int64)
    flat[place] = ids
    return flat, place


def _runs(link: np.ndarray, alone: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of places where each is linked with the next; places of ``alone`` are runs of one at least."""
    before = np.concatenate(([False], link[:-1]))
    inside = link | before if alone is None else link | before | alone
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~link) + 1
    keep = ends - starts >= least
    return starts[keep], (ends - starts)[keep]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class TestSuffixes:
    """The benchmark's words as numbers; every place is a suffix, and one that starts a window knows its length."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.names = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        h, doc = word_hashes(data, offsets)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.flat, place = _parted(ids.astype(np.int64) + 1, doc)
        self.item = np.zeros(len(self.flat), np.int64)
        self.item[place] = doc
        size = np.bincount(doc, minlength=len(items))
        at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
        #: Place of each word in its item.
        self.start = np.zeros(len(self.flat), np.int64)
        self.start[place] = at
        left = size[doc] - at
        #: Words of the window that starts at a place, 0 if none does; an item shorter than a window is one.
        self.need = np.zeros(len(self.flat), np.int64)
        self.need[place] = np.where(left >= window, window, np.where(at == 0, left, 0))
        self.lengths = np.unique(self.need[self.need > 0])
        both = (self.flat[:-1] > 0) & (self.flat[1:] > 0)
        pair = np.where(both, self.flat[:-1] * (1 << 32) + self.flat[1:], 0)
        self.pairs, self.pair_at = np.unique(np.append(pair, 0), return_inverse=True)
        self.single = np.unique(self.flat[self.need == 1])


class ShardSuffixArray:
    """Suffixes of some documents and of the benchmark, ranked together, as far as they may share ``least`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, test: TestSuffixes, least: int):
        h, self.doc = word_hashes(data, offsets)
        v = test.vocabulary
        at = np.minimum(np.searchsorted(v, h), len(v) - 1) if len(v) else np.zeros(len(h), np.int64)
        ids = np.where(v[at] == h, at + 1, 0).astype(np.int64) if len(v) else np.zeros(len(h), np.int64)
        flat, place = _parted(ids, self.doc)
        pair = np.append(flat[:-1] * (1 << 32) + flat[1:], 0)
        pair[(flat == 0) | np.append(flat[1:] == 0, True)] = 0
        some = np.flatnonzero(pair)
        near = np.minimum(np.searchsorted(test.pairs, pair[some]), len(test.pairs) - 1)
        some, near = (x[test.pairs[near] == pair[some]] for x in (some, near))
        link, which = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        link[some], which[some] = True, near
        lone = least == 1 and len(test.single)
        mine = _spread(*(runs := _runs(link, np.isin(flat, test.single) if lone else None, least)))
        held = np.zeros(len(test.pairs), bool)
        held[which[mine[link[mine]]]] = True
        theirs = _runs(held[test.pair_at] & (test.pairs[test.pair_at] > 0), np.isin(test.flat, test.single) if lone else None, least)
        # runs of both sides one after another, a 0 behind each
        size = np.concatenate((runs[1], theirs[1])).astype(np.int64)
        inside = _spread(np.cumsum(size + 1) - size - 1, size)
        self.ids = np.zeros(int((size + 1).sum()) + 1, np.int64)
        self.place = np.full(len(self.ids), -1, np.int64)
        places = np.concatenate((mine, _spread(*theirs)))
        self.place[inside] = places
        self.ids[inside] = np.concatenate((flat[mine], test.flat[places[len(mine) :]]))
        self.left = np.zeros(len(self.ids), np.int64)
        self.left[inside] = np.repeat(size, size) - (inside - np.repeat(np.cumsum(size + 1) - size - 1, size))
        self.mine, self.theirs = inside[: len(mine)], inside[len(mine) :]
        word = np.full(len(flat), -1, np.int64)
        word[place] = np.arange(len(h))
        #: Word of each ranked suffix of the documents, by its entry.
        self.word = np.full(len(self.ids), -1, np.int64)
        self.word[self.mine] = word[mine]
        self.levels = [self.ids]
        most = int(self.left.max(initial=0))
        while (k := 1 << (len(self.levels) - 1)) < most:
            rank, full = self.levels[-1], np.flatnonzero(self.ids)
            after = np.where(self.left[full] > k, rank[np.minimum(full + k, len(rank) - 1)], 0)
            new = np.zeros(len(rank), np.int64)
            new[full] = np.unique(rank[full] * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
            self.levels.append(new)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that each two suffixes share from the start."""
        out, last = np.zeros(len(a), np.int64), len(self.ids) - 1
        for k in reversed(range(len(self.levels))):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            same = (self.levels[k][x] == self.levels[k][y]) & (self.left[x] >= 1 << k) & (self.left[y] >= 1 << k)
            out += same << k
        return out

    def nearest(self, queries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, entry) of the longest match of each query suffix: binary search, then the neighbours of its place."""
        if not len(among) or not len(queries):
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        rank = self.levels[-1]
        among = among[np.argsort(rank[among], kind="stable")]
        lo = np.searchsorted(rank[among], rank[queries])
        left, right = among[np.maximum(lo - 1, 0)], among[np.minimum(lo, len(among) - 1)]
        a, b = self.common(queries, left), self.common(queries, right)
        return np.maximum(a, b), np.where(b >= a, right, left)

    def prefixes(self, entries: np.ndarray, n: int) -> np.ndarray:
        """A number for the first n words of each suffix (0 where it has fewer); equal numbers, equal words."""
        ok = self.left[entries] >= n
        code, off = np.zeros(len(entries), np.int64), 0
        for k in reversed(range(len(self.levels))):
            while n - off >= 1 << k:
                rank = self.levels[k][np.minimum(entries + off, len(self.ids) - 1)]
                code = np.unique(code * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)[1].astype(np.int64)
                off += 1 << k
        return np.where(ok, code + 1, 0)


def _hits(array: ShardSuffixArray, test: TestSuffixes, n: int):
    """(hit flag of each word, items of each document, longest match of each document as (words, its word, item)); the first of ties."""
    hit = np.zeros(len(array.doc) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(n)]
    longest, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = test.need[array.place[array.theirs]]
    for size in test.lengths.tolist():
        codes = array.prefixes(np.concatenate((array.mine, array.theirs)), size)
        a, b = codes[: len(array.mine)], np.where(need == size, codes[len(array.mine) :], 0)
        found = np.flatnonzero(np.isin(a, b[b > 0]) & (a > 0))
        if not len(found):
            continue
        entries = array.mine[found]
        word = array.word[entries]
        doc = array.doc[word]
        hit += np.bincount(word, minlength=len(hit)) - np.bincount(word + size, minlength=len(hit))
        order = np.argsort(b, kind="stable")
        for d, code in np.unique(np.stack([doc, a[found]], axis=1), axis=0).tolist():
            lo, hi = np.searchsorted(b[order], [code, code + 1])
            items[d].update(test.item[array.place[array.theirs[order[lo:hi]]]].tolist())
        length = array.nearest(entries, array.theirs)[0] if size == test.window else np.full(len(entries), size)
        for d, m, e in zip(doc.tolist(), length.tolist(), entries.tolist(), strict=True):
            if m > longest[d]:
                longest[d], at[d] = m, e
    best: list[tuple] = [(0, None, None)] * n
    first = np.searchsorted(array.doc, np.arange(n))
    for m in np.unique(longest[longest > 0]).tolist():
        of = np.flatnonzero(longest == m)
        codes = array.prefixes(np.concatenate((at[of], array.theirs)), m)
        a, b = codes[: len(of)], np.where((need == m) | (m >= test.window), codes[len(of) :], 0)
        order = np.argsort(b, kind="stable")
        item = test.item[array.place[array.theirs[order[np.searchsorted(b[order], a)]]]]
        for d, i in zip(of.tolist(), item.tolist(), strict=True):
            best[d] = (m, int(array.word[at[d]] - first[d]), i)
    return np.cumsum(hit[:-1]) > 0, items, best


def _parts(benchmark: DataFrame):
    """Number of parts, and a function that collects one."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART_BYTES) or 1
    part = lambda k: rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return n, lambda k: sorted(((r.item_id, r.text) for r in part(k).collect()), key=lambda x: (x[0] is None, x))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns c0.. of ``docs``, then x0 n_words, x1 n_hit, x2 item ids (sorted strings), and the longest
    verbatim match of a window or more, or of a whole shorter item: x3 its words (0: none), x4 its first
    word in the document, x5 its item (null: without item_id).

    Null and blank texts have no words and no hits.  Items without words are
    nobody's; an item shorter than a window is one window; equal items all
    count, an item_id once for a text, and items without item_id hit but aren't
    named.  A text is taken whole, however long; repeated rows count each; other
    columns stay, whatever their names; an empty table gives none.
    """
    scratch = C.Scratch(docs.sparkSession)
    out, n_cols, names = docs, len(docs.columns), list(docs.columns)
    n_parts, part_of = _parts(benchmark)
    for k in range(n_parts):
        test = TestSuffixes(part_of(k), window)
        index = docs.sparkSession.sparkContext.broadcast(test)
        last = k == n_parts - 1

        def make(index=index, first=k == 0, last=last):
            test = index.value
            least = int(test.lengths.min(initial=window))

            def step(part, data, offsets):
                array = ShardSuffixArray(data, offsets, test, least)
                n = len(offsets) - 1
                hit, items, best = _hits(array, test, n)
                bounds = np.searchsorted(array.doc, np.arange(n + 1))
                words = np.diff(bounds)
                masks = [np.packbits(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                found = [{test.names[i] for i in x} for x in items]
                best = [(m, w, None if i is None else test.names[i]) for m, w, i in best]
                if not first:
                    old = [part.column(n_cols + j).to_pylist() for j in range(6)]
                    masks = [m | np.frombuffer(x, np.uint8) for m, x in zip(masks, old[1], strict=True)]
                    found = [x | set(y) for x, y in zip(found, old[2], strict=True)]
                    best = [x if x[0] > y[0] else y for x, y in zip(best, zip(*old[3:], strict=True), strict=True)]
                done = pa.array([int(np.unpackbits(m).sum()) for m in masks], pa.int64()) if last else pa.array([m.tobytes() for m in masks], pa.binary())
                length, start, item = zip(*best, strict=True)
                return [pa.array(words, pa.int64()), done, pa.array([sorted(x - {None}) for x in found], pa.list_(pa.string())), pa.array(length, pa.int64()), pa.array(start, pa.int64()), pa.array(item, pa.string())]

            return step

        fields = f"long, {'long' if last else 'binary'}, array<string>, long, long, string"
        mapped = C.append_columns(out.toDF(*names, *out.columns[n_cols:]), make, fields)
        # the newest columns replace those of the pass before
        out = mapped.select(*[f"c{i}" for i in range(n_cols)], *[f"x{j}" for j in range(6)])
        if not last:
            out = scratch.save(out)
            index.destroy()
        out = out.toDF(*names, *[f"x{j}" for j in range(6)])
    return out.toDF(*[f"c{i}" for i in range(n_cols)], *[f"x{j}" for j in range(6)])


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, contaminated (n_hit > 0 and share * n_hit >= n_words), longest_words,
    longest_start, longest_item of every row; see ``scan`` for odd input."""
    docs = docs.select("doc_id", "text")
    found = C.pick(scan(docs, benchmark, window), docs, ["doc_id"], n_words="x0", n_hit="x1", item_ids="x2", longest_words="x3", longest_start="x4", longest_item="x5")
    return found.select("doc_id", "n_words", "n_hit", "item_ids", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words").alias("contaminated"), "longest_words", "longest_start", "longest_item")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` without a verbatim match of a window or more, in one pass without a shuffle.

    An item shorter than a window is too common to tell alone: a document that
    holds one whole goes if hit words are 1 in ``share`` of its words or more.
    Null, empty and blank texts stay, as do repeated rows and all columns; an
    empty table or an empty benchmark changes nothing; see ``scan``.
    """
    found = scan(docs, benchmark, window)
    return C.pick(found.where(f"not (x3 >= {window} or (x1 > 0 and {share} * x1 >= x0))"), docs, docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = 2) -> DataFrame:
    """For every item suffix the longest verbatim match over all shards: item_id, start, length, doc_id (smallest of ties).

    Each shard reports at most one match a suffix; the longest is kept by a
    pre-aggregated maximum.  Matches under ``least`` words are not reported;
    items without item_id and empty texts have none.
    """
    spark = docs.sparkSession
    out = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_parts, part_of = _parts(benchmark.where("item_id is not null"))
    for k in range(n_parts):
        index = spark.sparkContext.broadcast(TestSuffixes(part_of(k), window))

        def find(batches, index=index):
            test = index.value
            names = np.array(test.names, object)
            for batch in batches:
                for part, data, offsets in C.text_steps(batch):
                    array = ShardSuffixArray(data, offsets, test, least)
                    length, _ = array.nearest(array.theirs, array.mine)
                    # of all places with the longest match, the one in the smallest doc_id (null last)
                    ids = np.array([NO_ID if x is None else x for x in part.column(0).to_pylist()], np.int64)[array.doc[array.word[array.mine]]]
                    mine = array.mine[by_id := np.argsort(ids, kind="stable")]
                    for m in np.unique(length[length >= least]).tolist():
                        query = array.theirs[length == m]
                        codes = array.prefixes(np.concatenate((query, mine)), m)
                        order = np.argsort(codes[len(query) :], kind="stable")
                        doc = ids[by_id][order[np.searchsorted(codes[len(query) :][order], codes[: len(query)])]]
                        where = array.place[query]
                        yield pa.RecordBatch.from_arrays([pa.array(names[test.item[where]], pa.string()), pa.array(test.start[where], pa.int64()), pa.array(np.full(len(query), m), pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID)], names=["item_id", "start", "length", "doc_id"])

        got = docs.mapInArrow(find, "item_id string, start long, length long, doc_id long")
        got = got.groupBy("item_id", "start").agg(F.max_by(F.struct("length", "doc_id"), F.struct("length", F.col("doc_id").isNotNull(), -F.col("doc_id"))).alias("m")).select("item_id", "start", "m.length", "m.doc_id")
        if n_parts > 1:
            got = C.Scratch(spark).save(got)
            index.destroy()
        out = got if out is None else out.unionByName(got)
    return out.groupBy("item_id", "start").agg(F.max_by(F.struct("length", "doc_id"), F.struct("length", F.col("doc_id").isNotNull(), -F.col("doc_id"))).alias("m")).select("item_id", "start", "m.length", "m.doc_id")
