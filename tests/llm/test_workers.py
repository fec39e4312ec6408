"""What a Python worker still holds when its tasks are over; in a process of its own, so that nothing else counts."""

import json
import subprocess
import sys
from pathlib import Path

SCRIPT = r'''
import gc, json, random, re
import numpy as np, pyarrow as pa
from pyspark.sql import types as T
from cubeloom.llm import bpe, common as C, language_id, ngram_jaccard

# without a session nothing parses types; only names matter here
T.StructType.fromDDL = lambda ddl: T.StructType([T.StructField(x.split()[0], T.StringType()) for x in ddl.split(", ")])


class Table:
    """Stands for a DataFrame: mapInArrow gives the function that workers run."""

    columns, schema = ["text"], T.StructType.fromDDL("text string")

    def toDF(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def held():
    gc.collect()
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def batches(n):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(5000)]
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(rnd.choices(words, k=800)) for _ in range(3000)])], names=["text"])


def field():
    model = language_id.ChainField(["a", "b", "c", "d"])

    def step(part, data, offsets):
        model.marginals(language_id.Words(data, offsets))
        sets = list(ngram_jaccard.shingle_sets(data, offsets, 5))
        return [pa.array([len(s) for s in sets], pa.int64())]

    return step


encode = C.append_columns(Table(), bpe._columns(bpe.default_vocabulary(), False), "array<int>")
other = C.append_columns(Table(), field, "long")
first = held()
rows = sum(b.num_rows for b in encode(batches(1)))
again = [bpe._loaded.cache_info().currsize, sum(b.num_rows for b in encode(batches(1))), bpe._loaded.cache_info().misses]
rows += sum(b.num_rows for b in other(batches(2)))
print(json.dumps({"rows": rows, "again": again, "vocabularies": bpe._loaded.cache_info().currsize, "mb": held() - first}))
'''


def test_worker_hands_memory_back():
    """A vocabulary is read once for all tasks of its operator and goes when another one's begin; freed memory goes back."""
    repo = Path(__file__).resolve().parents[2]
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=repo, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    got = json.loads(run.stdout.splitlines()[-1])
    assert got["rows"] == 9000 and got["again"] == [1, 3000, 1]
    assert got["vocabularies"] == 0
    assert got["mb"] < 80, got
