"""N-gram Jaccard join by a count-vector R-tree.

Method.  A document's distinct shingles are hashed into groups, and the number
of shingles in each group is a coordinate: the overlap of two sets is at most
the sum of the coordinate minima.  ``CountVectorRTree`` indexes such points and
descends only into nodes whose upper corner can reach the wanted overlap; what is
left is verified on the sets themselves.

Distribution.  One R-tree over everything would not fit a task, so hashed groups
also route documents to each other.  Sizes are cut into bands; in a band with
at most d differing shingles between linked sets, shingles are dealt to
d + 1 + s groups.  At most d groups differ, so a pair of which one set leaves at
most s groups empty has a group with the same shingles, at least one, in both
(pigeonhole).  The content hash of each such group is a *cell*; only sets with
more than s empty groups, which are very rare, use those as cells too.

1. Cells with two sets or more stay; cells with the same members count once.
   Counts of BUCKETS buckets of cells tell which cells may be hot: any other has
   few rows against an average task, and only those meet by a shuffle on the cell.
2. Each cell's points go into an R-tree, and its members are joined where the
   bound lets them be linked.  Components of these joins are *blocks*.
3. Each block's texts meet once, and an R-tree search with exact verification
   finds their links.  Large cells and blocks are cut into hashed chunks, and
   every pair of chunks meets in a task of its own.

No link is lost, and nothing is capped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Coordinates of a point.
DIMS = 128
#: Upper sizes of bands grow by this factor.
BAND = 1.5
#: Shingles of one chunk of a block: blocks are cut into up to CHUNKS chunks of at least the first
#: figure, and into more only so that none holds more than the second on average.
CHUNK_SHINGLES, MOST_SHINGLES, CHUNKS = 100_000, 2_000_000, 8
#: Points of a cell that one chunk holds on average, and buckets in which rows of cells are counted.
CELL_POINTS, BUCKETS = 20_000, 1 << 16
#: Distinct sets that a task remembers so as to deal copies once.
SEEN = 200_000
#: Sets meet as 40 bits of their digest while blocks form; a chance meeting only adds a candidate.
NODE = (1 << 40) - 1
#: Children of a node of the tree.
FAN = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of A-Z lower-cased words."""
    data = C.lower_ascii(data)
    starts, ends, doc = C.split_words(data, offsets, C.SPACE_WORDS)
    h = C.hash_spans(data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    if len(h) >= words:
        n = len(h) - words + 1
        grams = C.combine([h[k : k + n] for k in range(words)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield C.combine([h[a + k : a + k + 1] for k in range(b - a)] + [np.array([b - a], C.U64)])
        else:
            yield np.zeros(0, C.U64)


@functools.cache
def band_edge(k: int) -> int:
    """Band k holds sizes from edge k up to edge k + 1 less one."""
    return 1 if k == 0 else max(band_edge(k - 1) + 1, int(band_edge(k - 1) * BAND))


def _differing(upper: int, num: int, den: int) -> int:
    """The most differing shingles of linked sets whose larger size is at most ``upper``.

    Similarity >= num/den means overlap * (num + den) >= num * (a + b); so
    a + b - 2 * overlap <= (a + b) * (den - num) / (den + num).
    """
    return 2 * upper * (den - num) // (den + num)


def _spare(differing: int, smallest: int) -> int:
    """Groups that may stay empty: what hashing ``smallest`` shingles leaves empty, with a wide margin."""
    spare = 0
    while differing:
        empty = (groups := differing + 1 + spare) * math.exp(-smallest / groups)
        if spare >= min(empty + 4 * math.sqrt(empty) + 0.5, smallest):
            break
        spare += 1
    return spare


@functools.cache
def _groups(k: int, num: int, den: int) -> tuple[int, int]:
    """(groups, how many may be empty) of band k."""
    low, high = band_edge(k), band_edge(k + 1)
    differing = _differing(high - 1, num, den)
    spare = _spare(differing, low)
    return differing + 1 + spare, spare


def cells_of(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Cell hashes of one set: its groups in its own band, and in the next ones if larger partners may be there.

    A chance meeting of cells only adds a candidate, so 48 bits are enough.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    k = 0
    while band_edge(k + 1) <= n:
        k += 1
    out = []
    with np.errstate(over="ignore"):
        while band_edge(k) * num <= n * den:
            groups, spare = _groups(k, num, den)
            at = ((shingles >> C.U64(32)) * C.U64(groups)) >> C.U64(32)
            # shingles ascend, so those of a group stand together
            cuts = np.searchsorted(at, np.arange(groups))
            held = np.diff(np.append(cuts, n)) > 0
            sums = np.zeros(groups, C.U64)
            sums[held] = np.add.reduceat(C.mix(shingles + C.U64(k + 1)), cuts[held])
            cells = C.combine([sums, np.arange(groups, dtype=C.U64) + C.U64(k << 32)])
            out.append(cells if groups - held.sum() > spare else cells[held])
            k += 1
    return (np.concatenate(out) >> C.U64(16)).astype(np.int64)


def _linked(inter: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray:
    return den * inter >= num * (a + b - inter)


def digest(shingles: np.ndarray) -> bytes | None:
    """128 bits for a set; none for the empty one."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        return np.array([C.mix(shingles).sum(dtype=C.U64), C.mix(shingles ^ C.U64(0xA0761D6478BD642F)).sum(dtype=C.U64)], ">u8").tobytes()


def node_of(name: bytes) -> int:
    return int.from_bytes(name[:8], "big") & NODE


class CountVectorRTree:
    """Points in sorted order, packed FAN to a node on every level up to the root; each node keeps its upper corner.

    A query of size n needs an overlap of num * (n + m) / (num + den) with a
    point of size m.  A node is opened if the summed minima with its upper corner
    reach that for its smallest m, a point is a candidate if its own sum does.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        keys = [points[:, g] for g in range(0, points.shape[1], max(1, points.shape[1] // 4))][:4]
        self.order = np.lexsort([*keys, sizes])
        #: Of each level, from the points up: upper corners, smallest and largest sizes, points not removed.
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], np.ones(len(sizes), np.int64))]
        while len(self.levels[-1][1]) > FAN:
            upper, small, large, left = self.levels[-1]
            cuts = np.arange(0, len(small), FAN)
            self.levels.append((np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts), np.add.reduceat(left, cuts)))
        self.place = np.empty(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(sizes))

    def remove(self, ids: np.ndarray) -> None:
        at = self.place[ids]
        at = at[self.levels[0][3][at] > 0]
        for k, level in enumerate(self.levels):
            np.subtract.at(level[3], at // FAN**k, 1)

    def query(self, point: np.ndarray, n: int) -> np.ndarray:
        """Ids of the points, not removed, whose bound reaches the similarity."""
        num, den = self.num, self.den
        at = np.arange(len(self.levels[-1][1]))
        for k in reversed(range(len(self.levels))):
            upper, small, large, left = self.levels[k]
            at = at[(left[at] > 0) & (large[at] * den >= n * num) & (small[at] * num <= n * den)]
            if not len(at):
                break
            bound = np.minimum(upper[at], point).sum(axis=1, dtype=np.int64)
            at = at[bound * (num + den) >= num * (n + np.maximum(small[at], -(-n * num // den)))]
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][1])]
        return self.order[at]


def count_vector(shingles: np.ndarray, dims: int = 0) -> np.ndarray:
    """Group counts of a set; by default as many groups, a power of two, as keep counts small and bounds tight."""
    if not dims:
        dims = 16
        while dims * 6 < len(shingles):
            dims *= 2
    out = np.bincount((shingles & C.U64(dims - 1)).astype(np.int64), minlength=dims)
    return out if not len(out) or out.max() < 256 else count_vector(shingles, 2 * dims)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of different dimension (powers of two) over the groups of the smallest."""
    dims = min(len(p) for p in points)
    return np.stack([p.astype(np.int32).reshape(-1, dims).sum(axis=0) for p in points])


def bound_components(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each point the position of the first one reachable where the bound reaches the similarity."""
    points = folded(points)
    root = np.full(len(sizes), -1, np.int64)
    if len(sizes) <= 3:
        root = np.arange(len(sizes))
        for i in range(len(sizes)):
            for j in range(i):
                if root[i] != root[j] and _linked(np.minimum(points[i], points[j]).sum(), sizes[i], sizes[j], num, den):
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        return root
    tree = CountVectorRTree(points, sizes, num, den)
    for first in range(len(sizes)):
        if root[first] < 0:
            root[first] = first
            tree.remove(np.array([first]))
            queue = [first]
            while queue:
                q = queue.pop()
                got = tree.query(points[q], int(sizes[q]))
                root[got] = first
                tree.remove(got)
                queue.extend(got.tolist())
    return root


class Block:
    """The sets of a block as numbers, and their tree."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.ends = np.cumsum(self.sizes)
        self.points = folded([count_vector(s, DIMS) for s in sets])
        self.tree = CountVectorRTree(self.points, self.sizes, num, den)
        self.mark = np.zeros(len(names), np.uint8)

    def found(self, q: int) -> np.ndarray:
        """Sets, not removed, that are linked with set q."""
        near = np.sort(self.tree.query(self.points[q], int(self.sizes[q])))
        own = self.flat[self.ends[q] - self.sizes[q] : self.ends[q]]
        self.mark[own] = 1
        out = []
        for at in range(0, len(near), 4096):
            part = near[at : at + 4096]
            size = self.sizes[part]
            a, b = int(self.ends[part[0]] - size[0]), int(self.ends[part[-1]])
            if b - a <= 2 * size.sum():  # nearly all sets of a stretch
                every = np.arange(part[0], part[-1] + 1)
                hits = np.add.reduceat(self.mark[self.flat[a:b]], (self.ends - self.sizes)[every] - a, dtype=np.int64)[part - part[0]]
            else:
                cuts = np.cumsum(size) - size
                index = np.repeat(self.ends[part] - size - cuts, size) + np.arange(size.sum())
                hits = np.add.reduceat(self.mark[self.flat[index]], cuts, dtype=np.int64)
            out.append(part[_linked(hits, int(self.sizes[q]), size, self.num, self.den)])
        self.mark[own] = 0
        return np.concatenate(out) if out else near


def components_within(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the position of the first one reachable by links.

    Walks links breadth first.  A set that was reached leaves the tree, so a
    large group of near copies costs one search for each member over what is
    still unreached, and never its pairs.
    """
    root = np.full(len(sets), -1, np.int64)
    if not len(sets):
        return root
    block = Block(sets, num, den)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        block.tree.remove(np.array([first]))
        queue = [first]
        while queue:
            got = block.found(queue.pop())
            root[got] = first
            block.tree.remove(got)
            queue.extend(got.tolist())
    return root


def links_within(sets: list[np.ndarray], copies: np.ndarray, chunk: np.ndarray, counted: set[int], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """``components_within``, and for each set its links with documents of other sets.

    Pairs inside a chunk count only for the chunks in ``counted``, as they also meet in other tasks.
    """
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    if not len(sets):
        return root, links
    block = Block(sets, num, den)
    inside = np.isin(chunk, list(counted))
    for q in range(len(sets)):
        block.tree.remove(np.array([q]))
        got = block.found(q)
        if not len(got):
            continue
        met = np.unique(root[got])
        if len(met) > 1 or met[0] != root[q]:
            first = min(int(met[0]), int(root[q]))
            root[np.isin(root, met) | (root == root[q])] = first
        new = got[(chunk[got] != chunk[q]) | inside[q]]
        links[q] += copies[new].sum()
        links[new] += copies[q]
    return root, links


def _dealt(rows: DataFrame, key: str, member: str, chunks: Column, total: int) -> DataFrame:
    """Rows with the task key (k0, k1, k2): groups of one chunk share hashed tasks of
    some thousand rows; others send each row to every pair of chunks with its own."""
    bins = F.lit(max(1, -(-total // 4096)))
    rows = rows.withColumn("_c", F.greatest(chunks.cast("long"), F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_c"))).withColumn("own", F.col("_own"))
    rows = rows.withColumn("_o", F.explode(F.expr("sequence(0L, _c - 1)"))).where("_c = 1 or _o <> _own")
    one = F.col("_c") == 1
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.when(one, F.pmod(F.xxhash64(key), bins)).otherwise(F.col(key)).alias("k0"),
        F.when(one, F.lit(-1)).otherwise(F.least("_o", "_own")).alias("k1"),
        F.when(one, F.lit(-1)).otherwise(F.greatest("_o", "_own")).alias("k2"),
    )


def _join_points(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Edges between members of each cell where the bound lets them be linked."""
    frame = frame.sort_values("k", kind="stable")
    key, node, size = (frame[c].to_numpy() for c in ("k", "node", "n"))
    points = [np.frombuffer(p, np.uint8) for p in frame["point"]]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    src, dst = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        root = bound_components(points[a:b], size[a:b], num, den)
        src.append(node[a:b])
        dst.append(node[a + root])
    out = pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})
    C.release(1)
    return out[out["src"] != out["dst"]].drop_duplicates()


def _shared_cells(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(k, node, m): members of each cell with m > 1 of them; cells with the same members have one k."""
    # rows of each bucket of cells: a bucket not far over the average has no hot cell
    bucket = F.pmod(F.xxhash64("cell"), F.lit(BUCKETS)).cast("int")
    counts = scratch.save(rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    hot = [r.bucket for r in counts.where(F.col("n") > 2 * mean + CELL_POINTS).select("bucket").collect()]  # at most BUCKETS / 2
    name = lambda total, m, least: F.xxhash64(total, m, least).alias("k")
    few = rows if not hot else rows.where(~bucket.isin(hot))
    # one shuffle by cell serves the distinct, the counts and the digest of the members
    few = few.repartition("cell").dropDuplicates(["cell", "node"])
    each = Window.partitionBy("cell")
    met = few.withColumns({"m": F.count("*").over(each), "total": F.bit_xor(F.xxhash64("node")).over(each), "least": F.min("node").over(each)}).where("m > 1")
    met = met.select(name("total", "m", "least"), "node", "m").distinct()
    if hot:
        # rows of a hot cell are dealt by cell and node, and only its sums by the cell
        many = scratch.save(rows.where(bucket.isin(hot)).distinct())
        sums = many.groupBy("cell").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("total"), F.min("node").alias("least")).where("m > 1")
        sums = scratch.save(sums.select("cell", "m", name("total", "m", "least")).groupBy("k").agg(F.min("cell").alias("cell"), F.first("m").alias("m")))
        met = met.unionByName(C.keyed_join(many, sums, "cell", sums.count()).select("k", "node", "m"))
    return scratch.save(met)


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, count_links: bool = True) -> DataFrame:
    """Classes of documents linked by shingle similarity >= num / den.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), set_id
    and, unless ``count_links`` is off, n_links (documents linked with it, copies
    included) for every row of ``docs``.  Texts are lower-cased (A-Z) and split at
    white space; with fewer than ``words`` words the whole sequence is the one
    shingle.  Null, empty and blank texts have no shingles and are linked with
    nothing.  Repeated rows are equal sets and so linked; a doc_id may have
    several texts; a very long text is one set; extra columns are ignored; an
    empty table gives an empty result; a null doc_id keeps its row and gets the
    component of its text, which is null if no row in it has a doc_id.  Equal
    sets are recognised by a 128-bit digest.

    Counting looks at every pair of distinct sets in a block that the tree lets
    through; without it a set that was reached is not looked at again.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with C.worker_task(__name__):
            for batch in batches:
                for part, data, offsets in C.text_steps(batch):
                    sets = list(shingle_sets(data, offsets, words))
                    points = [count_vector(s).astype(np.uint8).tobytes() for s in sets]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array(points, pa.binary())], names=["doc_id", "n_shingles", "sid", "point"])
                batch = part = data = offsets = sets = points = None
                C.release()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        with C.worker_task(__name__):
            for batch in batches:
                for part, data, offsets in C.text_steps(batch):
                    sets, names = [], []
                    for s in shingle_sets(data, offsets, words):
                        if len(s) and (d := digest(s)) not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(d)
                            sets.append(s)
                            names.append(node_of(d))
                    cells = [cells_of(s, num, den) for s in sets]
                    node = np.repeat(np.array(names, np.int64), [len(c) for c in cells])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*cells, np.zeros(0, np.int64)])), pa.array(node)], names=["cell", "node"])
                batch = part = data = offsets = sets = cells = node = None
                C.release()
            seen.clear()

    table = scratch.save(texts.mapInArrow(sketch, "doc_id long, n_shingles long, sid binary, point binary"))
    reps = table.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.count("*").alias("copies"))
    reps = scratch.save(reps.withColumn("node", F.conv(F.substring(F.hex("sid"), 7, 10), 16, 10).cast("long")))  # as node_of
    met = _shared_cells(texts.mapInArrow(deal, "cell long, node long"), scratch)
    joins = _dealt(met.join(reps.select("node", "n", "point"), "node"), "k", "node", F.ceil(F.col("m") / CELL_POINTS), met.count())
    joins = joins.groupBy("k0", "k1", "k2").applyInPandas(lambda f: _join_points(f, num, den), "src long, dst long")
    blocks = scratch.save(C.connected_components(joins, scratch))

    inside = scratch.save(blocks.join(reps.select("node", "sid", "doc_id", "n", "copies"), "node"))
    load = inside.groupBy("root").agg(F.sum("n").alias("load"))
    chunks = F.greatest(F.least(F.ceil(F.col("load") / CHUNK_SHINGLES), F.lit(CHUNKS)), F.ceil(F.col("load") / MOST_SHINGLES))
    heavy = scratch.save(load.where(F.col("load") > CHUNK_SHINGLES).select("root", chunks.alias("chunks")))
    members = C.keyed_join(inside, heavy, "root", heavy.count(), "left")
    members = scratch.save(members.select("doc_id", "sid", "copies", F.col("root").alias("k"), F.coalesce("chunks", F.lit(1).cast("long")).alias("chunks")))
    count, most = members.agg(F.count("*"), F.max("chunks")).first()
    sent = _dealt(members, "k", "sid", F.col("chunks"), count * 16)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": [], "dst": [], "links": []})]
        for _, block in frame.groupby("k", sort=False):
            batch = pa.RecordBatch.from_arrays([pa.array(block["text"].tolist(), pa.large_string())], names=["text"])
            sets = [s for _, d, o in C.text_steps(batch) for s in shingle_sets(d, o, words)]
            # a doc_id may have other texts too, and one text several rows
            at = {d: i for i, (s, d) in enumerate(zip(sets, block["sid"], strict=True)) if digest(s) == d}
            keep = sorted(at.values())
            sets, ids = [sets[i] for i in keep], block["sid"].to_numpy()[keep]
            if count_links and len(sets):
                own, total = block["own"].to_numpy()[keep], int(block["chunks"].iloc[0])
                here = {int(block["k1"].iloc[0]), int(block["k2"].iloc[0])}
                counted = {c for c in set(own.tolist()) if total == 1 or here == {c, (c + 1) % total}}
                root, links = links_within(sets, block["copies"].to_numpy()[keep], own, counted, num, den)
            else:
                root = components_within(sets, num, den)
                links = np.zeros(len(sets), np.int64)
            out.append(pd.DataFrame({"src": ids, "dst": ids[root], "links": links}))
            sets = batch = None
        C.release(1)
        return pd.concat(out)

    few = count * min(most or 1, CHUNKS) <= C.BROADCAST_ROWS and (most or 1) <= CHUNKS
    # a set that only rows without doc_id have takes its text from one of them
    lost = members.where("doc_id is null").select("sid").limit(1).count()
    met_texts = texts.join(F.broadcast(sent) if few else sent, "doc_id")
    if lost:
        named = texts.where("doc_id is null").dropDuplicates(["text"]).mapInArrow(sketch_of(words), "text string, sid binary")
        met_texts = met_texts.unionByName(named.join(sent.where("doc_id is null"), "sid").select(met_texts.columns))
    links = scratch.save(met_texts.groupBy("k0", "k1", "k2").applyInPandas(search, "src binary, dst binary, links long"))
    classes = scratch.save(C.connected_components(links.select("src", "dst"), scratch).withColumnRenamed("node", "sid"))
    n = classes.count()
    per_set = reps.select("sid", "doc_id", "copies").join(classes, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = scratch.save(classes.join(reps.select("sid", "doc_id"), "sid").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    sums = links.groupBy(F.col("src").alias("sid")).agg(F.sum("links").alias("links"))
    named = C.keyed_join(per_set, smallest, "root", n, "left").join(sums, "sid", "left")
    named = scratch.save(named.select("sid", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = C.keyed_join(table.drop("point"), named, "sid", named.count(), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("sid").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if count_links else out.drop("n_links")


def sketch_of(words: int):
    """Texts with the digests of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with C.worker_task(__name__):
            for part, data, offsets in (step for batch in batches for step in C.text_steps(batch)):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([digest(s) for s in shingle_sets(data, offsets, words)], pa.binary())], names=["text", "sid"])

    return run


def keep_representatives(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, with all columns; rows without doc_id stay.

    Rows repeated with one doc_id stay or go together, and a doc_id with several
    texts goes if one of them has a smaller document in its class.  Null, empty
    and blank texts stay; an empty table stays empty.
    """
    classes = ngram_jaccard_join(docs, words, num, den, count_links=False)
    dropped = C.Scratch(docs.sparkSession).save(classes.where("component_id < doc_id").select("doc_id").distinct())
    gone = F.broadcast(dropped) if dropped.count() <= C.BROADCAST_ROWS else dropped
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
