"""Shared pieces: shared-folder tables, workers' memory, vectorised words and hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that one vectorised step takes at a time (or one document); arrays of a step take up to 100 bytes for each.
STEP_BYTES = 1 << 18
#: Bytes of one hashing block.
BLOCK = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ scratch


class Scratch:
    """Tables in the folder that driver and executors share.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset and
    Spark runs in this very process (local tests) a temporary folder stands in.  ``save`` cuts the lineage by
    writing Parquet, so a lost executor costs a re-read and no recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.gettempdir()
        self.root = f"{base.rstrip('/')}/cubeloom-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing lazy refers to any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ----------------------------------------------------------------- workers

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_released = [0.0]
_kept: dict[str, Callable[[], None]] = {}


def release(wait: float = 0.0) -> None:
    """Hand memory that was freed back to the system; allocators keep it, and a worker outlives its tasks.

    Nothing is done within ``wait`` seconds of the last time.
    """
    if time.monotonic() - _released[0] >= wait:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
        _released[0] = time.monotonic()


def keep_for(module: str, drop: Callable[[], None]) -> None:
    """A worker keeps something for the tasks of a module; ``drop`` is called when a task of another one begins."""
    _kept[module] = drop


@contextlib.contextmanager
def worker_task(module: str) -> Iterator[None]:
    """Around the work of a task: what the worker keeps for other modules goes first, freed memory goes at the end."""
    for other in [m for m in _kept if m != module]:
        _kept.pop(other)()
    try:
        yield
    finally:
        release()


# ------------------------------------------------------------------- arrow


def text_steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with (bytes, offsets) of a string column; null counts as empty.

    A slice holds at most STEP_BYTES of text, or one row, so working memory
    follows the longest text and never the batch.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null slot may keep bytes behind it
        col = pa.array([x or "" for x in col.to_pylist()], pa.large_string())
        raw = col.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[: len(col) + 1]
        data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1
        to = min(len(col), max(to, at + 1))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def append_columns(docs: DataFrame, make: Callable[[], Callable], fields: str | list[str], column: str = "text") -> DataFrame:
    """``docs`` with computed columns behind its own, without a shuffle.

    ``make()`` runs once a task and returns a function of (batch slice, bytes,
    offsets) giving one Arrow array for each field.  Computed columns are named
    x0, x1, ... after c0, c1, ... for the columns of ``docs``, so no name of the
    caller's can clash; ``pick`` names them.
    """
    staged = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(column)}"
    kinds = [f.strip() for f in (fields.split(",") if isinstance(fields, str) else fields)]
    schema = T.StructType([*staged.schema.fields, *T.StructType.fromDDL(", ".join(f"x{i} {k}" for i, k in enumerate(kinds))).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        with worker_task(make.__module__):
            for batch in batches:
                for part, data, offsets in text_steps(batch, text):
                    step = step or make()
                    yield pa.RecordBatch.from_arrays([*part.columns, *step(part, data, offsets)], names=[f.name for f in schema])
                batch = part = data = offsets = None
                release()
            step = None

    return staged.mapInArrow(run, schema)


def pick(mapped: DataFrame, docs: DataFrame, keep: list[str], **computed: Column | str) -> DataFrame:
    """Columns of ``docs`` by name, then the computed ones."""
    return mapped.select(*[F.col(f"c{docs.columns.index(k)}").alias(k) for k in keep], *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in computed.items()])


# ------------------------------------------------------------------- words


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Words [^\x20\x09-\x0D]+
SPACE_WORDS = byte_table(lambda b: not (b == 0x20 or 9 <= b <= 13))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of all maximal runs of bytes in the table; runs end with their text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], m[:-1]))
    after = np.concatenate((m[1:], [False]))
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        # as long as a step; beyond that doubled
        size = STEP_BYTES + 1 if n <= STEP_BYTES + 1 else 1 << n.bit_length()
        _POW[:] = [_powers(_P, size), _powers(_PINV, size)]
    return _POW[0], _POW[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; starts ascend.  A polynomial over mixed
    byte values from prefix sums, so the cost is a few array passes."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = int(np.searchsorted(starts, lo + BLOCK))
            hi = int(ends[i:j].max())
            power, inverse = _tables(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            h = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverse[starts[i:j] - lo]
            out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(U64))
            i = j
    return out


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes."""
    with np.errstate(over="ignore"):
        h = mix(parts[0] + U64(0x632BE59BD9B4E019))
        for p in parts[1:]:
            h = mix(h * U64(0x2545F4914F6CDD1D) + p)
    return h


# ------------------------------------------------------------- components


#: Rows of a table up to which it is counted small enough to broadcast (some 24 bytes each).
BROADCAST_ROWS = 1_000_000
#: Rows that a key may have in one task of a join, and tasks that share a key with more.
HOT_ROWS, SALTS = 200_000, 64


def keyed_join(rows: DataFrame, table: DataFrame, key: str, size: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of ``size`` rows with one row a key, whatever share of the rows a key has.

    A table counted small is broadcast, so rows are not dealt by key at all.
    Else keys with more than HOT_ROWS rows (at most one for each HOT_ROWS rows,
    found by a pre-aggregated count) get SALTS tasks: their rows are dealt among
    them and their table row is repeated for each.
    """
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of an undirected graph: root is the smallest node reachable.

    ``edges`` has src and dst.  Each round points every node at its smallest
    neighbour (a pre-aggregated minimum, so a star with a hot centre stays
    cheap), follows pointers twice, and contracts the edges along them; edges
    shrink until none is left, and the rounds' pointers are then composed.
    Joins on nodes are ``keyed_join``s, so a component that holds a large share
    of all nodes takes no task of its own.  Tables are written to the shared
    folder between rounds; only counts come to the driver.  Null ends are ignored.
    """

    def simple(df: DataFrame) -> DataFrame:
        return scratch.save(df.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())

    left = simple(edges)
    rounds: list[tuple[DataFrame, int]] = []
    while not rounds or left.limit(1).count():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = scratch.save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("to")))
        n = first.count()
        again = first.select(F.col("node").alias("to"), F.col("to").alias("far"))
        point = scratch.save(keyed_join(first, again, "to", n).select("node", F.col("far").alias("root")))
        rounds.append((point, n))
        a = point.select(F.col("node").alias("src"), F.col("root").alias("s"))
        b = point.select(F.col("node").alias("dst"), F.col("root").alias("d"))
        half = keyed_join(left, a, "src", n)
        half = half if n <= BROADCAST_ROWS else scratch.save(half)  # a salted join reads its rows twice
        left = simple(keyed_join(half, b, "dst", n).select(F.col("s").alias("src"), F.col("d").alias("dst")))
    out = rounds[0][0]
    for later, n in rounds[1:]:
        out = keyed_join(out, later.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", n, "left").select("node", F.coalesce("far", "root").alias("root"))
        out = out if n <= BROADCAST_ROWS else scratch.save(out)
    return out


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % n


def stretch(text: str, doc_id: str, size: int) -> Column:
    """A text of at most ``size`` characters whole; of a longer one, ``size`` characters from a place that its doc_id picks."""
    spare = F.greatest(F.char_length(text) - size, F.lit(0))
    return F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(doc_id).cast("string")), (spare + 1).cast("long")) + 1).cast("int"), F.lit(size))


def bounded_sample(docs: DataFrame, usable: Column, rows: int, seed: int, marks: DataFrame | None = None) -> DataFrame:
    """At most ``rows`` documents for a fit: distinct doc_ids (with the columns of ``marks``) and h, smallest hashes first.

    Only ids and hashes are shuffled and ordered, never texts, and a bound on
    the hash leaves about twice as many of them as needed, so what reaches the
    last task follows ``rows`` and not the table.  The result is small enough
    to broadcast.  Null doc_ids are never taken; ``marks`` has one row a doc_id.
    """
    ids = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id")
    ids = ids if marks is None else marks.join(ids, "doc_id", "left_semi")
    ids = Scratch(docs.sparkSession).save(ids.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))))
    n = ids.count()
    if n > 4 * rows:
        ids = ids.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * rows // n)
    return ids.dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(rows)
