import random

import pyarrow.parquet as pq
import pytest

from cubeloom.llm import bpe


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBPE(bpe.default_vocabulary())


def test_tree_at_every_cut(tree, monkeypatch):
    """Leaves of 1 to 40 characters: cuts fall at, before and inside every kind of piece; ids stay the library's."""
    rnd = random.Random(6)
    bits = ["don't", " we'll", "'re", "''s", "'", " '", "  ", "   ", "\n\n", " \n x", "\t", "a", " abc", "é", " éèß", "漢字", "😀", "12", " 345", "1e5", "!!", " --", "...", " ", " ", "'ve'd", "x's"]
    cases = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(250)]
    cases += ["a" * 700, " " * 500, " " * 300 + "x", "\n" * 200 + "  x", "'" * 300 + "s", "ab" * 300, "😀" * 150, "漢字" * 200, "é" * 333, " x" * 200, "'re" * 150, "a1" * 200, "=" * 999 + "'t", "x " * 64 + " " * 64 + "y"]
    want = [e.ids for e in tree.tok.encode_batch_fast(cases, add_special_tokens=False)]
    for leaf in (1, 2, 3, 5, 8, 16, 40):
        monkeypatch.setattr(tree, "leaf", leaf)
        monkeypatch.setattr(tree, "ranks", None if leaf in (3, 16) else tree.ranks)  # by the library too
        for c, w in zip(cases, want, strict=True):
            assert tree.encode(c) == w, (leaf, c)
        monkeypatch.undo()


def test_long_texts_of_the_table_go_through_the_tree(tree, monkeypatch):
    """All texts over a leaf are joined from leaves, and give the library's ids."""
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:4000] if t]
    long = [t for t in texts if len(t) > bpe.LEAF_CHARS]
    joins = []
    monkeypatch.setattr(tree, "_joined", lambda *a, f=tree._joined: joins.append(a[3]) or f(*a))
    got = tree.encode_many(long)
    assert got == [e.ids for e in tree.tok.encode_batch_fast(long, add_special_tokens=False)]
    assert len(joins) >= len(long) > 100


def test_one_piece_is_joined_by_windows(tree, monkeypatch):
    """A run of 200,000 letters is one piece: halves are joined inside it, and no window is as long as a leaf."""
    seen = []
    monkeypatch.setattr(tree, "_lib", lambda x, f=tree._lib: seen.extend(map(len, x)) or f(x))
    rnd = random.Random(3)
    piece = "".join(rnd.choice("abcdeth") for _ in range(200_000))
    ids = tree.encode(piece)
    monkeypatch.undo()
    assert max(seen) <= bpe.LEAF_CHARS and len(seen) > 48
    assert ids == tree._lib([piece])[0] and tree.decode(ids) == piece
