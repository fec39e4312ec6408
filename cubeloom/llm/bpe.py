"""BPE encoding and decoding with tree concatenation of long texts.

Texts of up to LEAF_CHARS characters are leaves: they go to the tokenizer whole.
A longer text is cut into leaves wherever their size falls, words and runs
included; leaves are encoded apart (in THREADS threads), and neighbours are then
joined pair by pair up a tree.  Around a join the nearest pieces of the
pre-tokenizer are split and encoded again, in a window that grows until both
sides agree: on the left it begins where a piece starts for sure, on the right a
piece starts where one of the right side's does.  Pieces depend only on the
place they start and on what follows, at most AHEAD characters past their end,
so beyond these places the sides' own ids hold.

A piece longer than a leaf that lies over a join was encoded in two parts; they
are joined inside the piece, where a window of the nearest ids grows until it
starts with the left side's id and ends with the right side's.  Every pair of
neighbours in the result then also stands side by side in some correct encoding,
which for byte-pair merges makes the whole sequence the tokenizer's own.

The argument holds for byte-level pre-tokenizers; any other vocabulary encodes
texts whole.  Leaves and windows of a byte-level vocabulary whose ids follow its
merges are encoded from ranks, which gives the library's ids at about a quarter
of its time; ``ranked`` tells when that holds, and any other keeps the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Characters of a leaf; longer texts go through the tree.
LEAF_CHARS = 4_096
#: A space between two ASCII letters: the pre-tokenizer starts a piece there, whatever stands around.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Threads that encode the leaves of one text.
THREADS = 2
#: Characters past its end that may decide a piece: a contraction reads three from its start, any other piece one past its end.
AHEAD = 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pieces of a byte-level pre-tokenizer.
BYTE_LEVEL_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def is_byte_level(spec: dict) -> bool:
    """Whether a vocabulary splits texts as a byte-level pre-tokenizer does, with nothing before it."""
    pre = spec["pre_tokenizer"] or {}
    return not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


def ranked(tok, special: dict[str, int]):
    """An encoder by ranks with the ids of ``tok``, or None where they could differ.

    Merging the adjacent pair whose joined bytes have the lowest id equals
    following the merge list when each merge makes the next id, and each
    token's own bytes encode to that token alone: pairs that join to a token
    are then always the two halves its merge names.
    """
    spec = json.loads(tok.to_str())
    model = spec["model"]
    plain = {"unk_token": None, "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "fuse_unk": False}
    if model.get("type") != "BPE" or any((model.get(k) or default) != default for k, default in plain.items()):
        return None
    if not is_byte_level(spec):
        return None
    if any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    chars, vocab = _byte_of(), {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in chars for t in vocab for c in t) or sorted(vocab.values()) != list(range(len(vocab))) or not all(c in vocab for c in chars):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(merges) != len(vocab) - 256 or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    if any([x.id for x in tok.model.tokenize(t)] != [i] for t, i in vocab.items()):
        return None
    import tiktoken

    ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PIECES, mergeable_ranks=ranks, special_tokens=special)


class TreeBPE:
    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        special = self.names = set(added)
        self.tree = is_byte_level(json.loads(self.tok.to_str()))
        self.ranks = ranked(self.tok, added)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.digits = [str(i) for i in range(self.tok.get_vocab_size())]
        self.sizes = np.array([len(self._token_bytes().get(i, b"")) for i in range(self.tok.get_vocab_size())])

    def _lib(self, texts: list[str]) -> list[list[int]]:
        """The tokenizer's ids of each text."""
        if self.ranks is not None:
            return [self.ranks.encode(t, allowed_special=self.names, disallowed_special=()) for t in texts]
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        """Encodings of two halves of one piece, joined exactly."""
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            # ids of byte tokens may stop inside a character: widen to whole characters
            while i > 0 and self._broken(left[i]):
                i -= 1
            while j < len(right) and self._broken(right[j]):
                j += 1
            window = self._lib([self.tok.decode(left[i:] + right[:j], skip_special_tokens=False)])[0]
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def _broken(self, token: int) -> bool:
        """Whether a token starts inside a character."""
        if token not in (memo := self.__dict__.setdefault("memo", {})):
            first = self.tok.id_to_token(token)[0]
            memo[token] = first in self._tails()
        return memo[token]

    def _tails(self) -> set[str]:
        if "tails" not in self.__dict__:
            self.tails = {c for c, b in _byte_of().items() if 0x80 <= b < 0xC0}
        return self.tails

    def _token_bytes(self) -> dict[int, bytes]:
        """Bytes of each token, as the byte-level decoder takes them; empty for other decoders."""
        if "token_bytes" not in self.__dict__:
            self.token_bytes = {}
            if type(self.tok.decoder).__name__ == "ByteLevel":
                chars = _byte_of()
                for i in range(self.tok.get_vocab_size()):
                    t = self.tok.id_to_token(i)
                    self.token_bytes[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        return self.token_bytes

    def _pieces(self, text: str) -> np.ndarray:
        """Starts of the pre-tokenizer's pieces of a text."""
        return np.array([a for _, (a, _) in self.tok.pre_tokenizer.pre_tokenize_str(text)], np.int64)

    def _tail(self, text: str, begin: int, end: int, size: int) -> int:
        """The start of a piece about ``size`` characters before the end: a space between two letters starts one whatever stands around, as does the begin."""
        while begin < end - size:
            m = SAFE.search(text, end - size, end - AHEAD)
            if m:
                return m.start()
            size *= 4
        return begin

    def _ids_of(self, ids: list[int], size: int, last: bool = False) -> int:
        """How many ids at an end of a list make up so many bytes."""
        part = self.sizes[ids[-size:] if last else ids[:size]] if size else np.zeros(0, np.int64)
        return int(np.searchsorted(np.cumsum(part[::-1] if last else part), size)) + 1 if size else 0

    def _joined(self, text: str, left: list[int], right: list[int], begin: int, middle: int, end: int) -> list[int]:
        """The ids of text[begin:end] from those of its two parts."""
        size = 64
        while True:
            a, b = self._tail(text, begin, middle, size), min(end, middle + size)
            starts, own = self._pieces(text[a:b]) + a, self._pieces(text[middle:b]) + middle
            same = np.intersect1d(starts, own)
            same = same[(same >= middle) & ((same <= b - AHEAD) | (b == end))]
            if len(same) or b == end:
                stop = int(same[0]) if len(same) else end
                break
            size *= 4
        bounds = [*starts[starts < stop].tolist(), stop]
        keep = len(left) - self._ids_of(left, len(text[a:middle].encode()), True)
        rest = self._ids_of(right, len(text[middle:stop].encode()))
        out = left[:keep]
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        # a long piece over the join, of which each side has a part as its last or first piece
        over = next(((x, y) for x, y in spans if y - x > self.leaf and x < middle < y), None)
        if over and int(self._pieces(text[a:middle])[-1]) + a == over[0] and (int(own[1]) if len(own) > 1 else end) == over[1] and (b == end or over[1] < b):
            x, y = over
            head, tail = len(text[x:middle].encode()), len(text[middle:y].encode())
            inside = self._join(left[len(left) - self._ids_of(left, head, True) :], right[: self._ids_of(right, tail)])
            parts = self._lib([text[p:q] for p, q in spans if (p, q) != over])
            parts.insert(spans.index(over), inside)
        else:
            parts = self._lib([text[p:q] for p, q in spans])
        for p in parts:
            out += p
        return out + right[rest:]

    def encode_long(self, text: str) -> list[int]:
        """A text of any length without special tokens, by the tree."""
        cuts = [*range(0, len(text), self.leaf), len(text)]
        leaves = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        with ThreadPoolExecutor(THREADS) as pool:
            parts = pool.map(self._lib, [leaves[k::THREADS] for k in range(THREADS)])
        ids: list = [None] * len(leaves)
        for k, got in enumerate(parts):
            ids[k::THREADS] = got
        nodes = list(zip(cuts[:-1], cuts[1:], ids, strict=True))
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [p[0] if len(p) == 1 else (p[0][0], p[1][1], self._joined(text, p[0][2], p[1][2], p[0][0], p[0][1], p[1][1])) for p in pairs]
        return nodes[0][2]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf or not self.tree:
            return self._lib([text])[0]
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.tok.token_to_id(part))
            elif part:
                out += self.encode_long(part) if len(part) > self.leaf else self._lib([part])[0]
        return out

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.leaf]
        out: list = [None] * len(texts)
        for i, ids in zip(short, self._lib([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.encode(t)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode: byte-level tokens are joined as bytes, anything else goes to the library."""
        try:
            return b"".join(map(self._token_bytes().__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return self.tok.decode(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> TreeBPE:
    """One reading of a vocabulary for each Python worker, until it takes tasks of another operator."""
    C.keep_for(__name__, _loaded.cache_clear)
    return TreeBPE(path)


def _columns(path: str, digests: bool):
    def make():
        bpe = _loaded(path)

        def step(part, data, offsets):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            out = bpe.encode_many(texts)
            if not digests:
                return [pa.array(out, pa.list_(pa.int32()))]
            digits = bpe.digits
            ids = [hashlib.sha256(",".join([digits[i] for i in x]).encode()).hexdigest() for x in out]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in out]
            return [pa.array([len(x) for x in out], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

        return step

    return make


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with a column token_ids (array<int>).  Null counts as empty, empty texts have no
    ids; very long texts go through the tree; repeated rows and other columns stay; a column
    named token_ids is replaced; an empty table stays empty."""
    keep = [c for c in docs.columns if c != "token_ids"]
    docs = docs.select(keep)
    return C.pick(C.append_columns(docs, _columns(path or default_vocabulary(), False), "array<int>"), docs, keep, token_ids="x0")


def bpe_decode(encoded: DataFrame, path: str | None = None, column: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token ids; null ids give null."""
    path = path or default_vocabulary()
    keep = [c for c in encoded.columns if c != to]
    schema = encoded.select(*keep).withColumn(to, encoded[column].cast("string")).schema

    def run(batches):
        at = keep.index(column)
        with C.worker_task(__name__):
            bpe = _loaded(path)
            for batch in batches:
                texts = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, to])

    return encoded.select(*keep).mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass."""
    docs = docs.select("doc_id", "text")
    return C.pick(C.append_columns(docs, _columns(path or default_vocabulary(), True), "long, string, string"), docs, ["doc_id"], n_tokens="x0", ids_sha256="x1", decoded_sha256="x2")
