"""Byte-level BPE: whole texts to token ids and back, by backtracking from the longest matches of an Aho-Corasick automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._spark import extended
from fieldloom.llm.tokens import model_path

#: Splits remembered in one worker, and the characters of the longest that is.
SPLITS, SPLIT = 400_000, 48
#: Pairs of tokens whose compatibility is remembered in one worker.
PAIRS = 500_000
#: Letters and numbers that Unicode has gained since version 16.0, first and last of each range. tiktoken's tables end
#: with 16.0, so these are neither letters nor numbers to it, while the regex module may know them.
LATER = (
    "0558 0558 058B 058C 088F 088F 0C5C 0C5C 0CDC 0CDC 208F 208F 209D 209F A7CE A7CF A7D2 A7D2 A7D4 A7D4 A7DD A7DD A7E2 A7E2 A7F1 A7F1 AB6C AB6D "
    "107BB 107BF 10940 10959 10EC5 10EC7 10ED9 10EEE 11B0A 11B0A 11DB0 11DDB 11DE0 11DE9 11DF1 11DF1 1246F 1246F 12475 1247F 12550 12686 "
    "16EA0 16EB8 16EBB 16ED3 16FF2 16FF6 187F8 187FF 18CD6 18CDA 18D09 18D20 18D80 18DF2 18E00 19191 191A0 191D2 1B123 1B128 1B168 1B168 "
    "1D6A6 1D6A6 1DF1F 1DF24 1DF2B 1DF81 1DF90 1DF96 1DFCD 1DFFF 1E6C0 1E6DE 1E6E0 1E6E2 1E6E4 1E6E5 1E6E7 1E6ED 1E6F0 1E6F4"
    " 1E6FE 1E6FF 2B73A 2B73F 2B81E 2B81E 2CEA2 2CEAD 323B0 33479 3D000 3FC3F"
).split()
#: Ids that one output batch holds at most, unless a single text has more, and that are decoded at once.
BATCH_IDS, PIECE_IDS = 1 << 20, 1 << 16


#: UTF-8 bytes of characters that come before all of LATER.
_EARLY = bytes(range(0xD5))
_NONE = 1 << 60


def read_ranks(file: str) -> list[bytes]:
    """The bytes of each token of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    with open(file, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    if sorted(ranks) != list(range(len(rows))):
        raise ValueError("the ranks of a file must be 0, 1, 2 and so on, each once")
    return [ranks[i] for i in range(len(rows))]


class ByteBPE:
    """The tokens of a rank file. Bytes stand as Latin-1 characters, so that an automaton over strings finds tokens in any bytes.

    A sequence of tokens is what merging gives exactly if every adjacent pair of it is compatible: if merging the bytes of the two
    gives the two again. The first merge over a boundary would happen in the pair alone as well, so this holds for any ranks.
    Only one sequence of a text is so; `encoded` finds it, with each pair's compatibility remembered.
    """

    def __init__(self, file: str, pattern: str):
        self.tokens = read_ranks(file)
        self.names = [t.decode("latin-1") for t in self.tokens]
        self.rank = {t: i for i, t in enumerate(self.names)}
        missing = [b for b in range(256) if chr(b) not in self.rank]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern must have no capturing groups")
        self.later = regex.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in zip(LATER[::2], LATER[1::2], strict=True)) + "]")
        self.pairs: dict[int, bool] = {}
        self.splits = _Splits(self)
        self.automaton = ahocorasick.Automaton()
        #: Tokens that merging can make; any other stands for a whole split only.
        made = [len(t) < 3 or self._merged(t) == [i] for i, t in enumerate(self.names)]
        for i, t in enumerate(self.names):
            if made[i]:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: The longest shorter token that each token begins with; -1 for single bytes.
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank and made[self.rank[t[:k]]]), -1) for t in self.names]
        self.length = [len(t) for t in self.names]

    def _merged(self, text: str) -> list[int]:
        """Plain merging, lowest rank first, the leftmost of equal ones; for tokens and pairs of tokens."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < _NONE:
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], _NONE)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], _NONE)
        return [self.rank[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._merged(self.names[left] + self.names[right]) == [left, right]
        return found

    def encoded(self, split: str) -> list[int]:
        """The ids of one split, its bytes given as Latin-1 characters: a token that is the whole split, or else what merging gives.

        Longest matches from the start on are right where all adjacent ones are compatible, which is the usual case. Otherwise each step
        takes the longest token from here on, then shorter ones that it begins with, until one is compatible with the last; where none
        is, the place is marked as dead and the last token gives way. What stands before a place is always what merging gives for
        that beginning, so a dead place stays dead, and the time is linear in the split's length.
        """
        whole = self.rank.get(split)
        if whole is not None:
            return [whole]
        n = len(split)
        greedy = [i for _, i in self.automaton.iter_long(split)]
        if all(map(self.compatible, greedy, greedy[1:])):
            return greedy
        longest, length = [-1] * n, self.length
        for end, i in self.automaton.iter(split):
            longest[end + 1 - length[i]] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, with LATER's characters taken for an unassigned one."""
        if not text.encode().translate(None, _EARLY) or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later.sub("\uffff", text))]

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, each match of the pattern separately; special strings are ordinary text."""
        return np.fromiter(chain.from_iterable(map(self.splits.__getitem__, self.split(text))), np.int32)


class _Splits(dict):
    """The ids of splits, found when first asked for; short ones are remembered, as many as SPLITS."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, split: str) -> tuple[int, ...]:
        found = tuple(self.bpe.encoded(split.encode().decode("latin-1")))
        if len(split) <= SPLIT:
            if len(self) >= SPLITS:
                self.clear()
            self[split] = found
        return found


class Decoder:
    """The bytes of a rank file's tokens, to put texts together from."""

    def __init__(self, file: str):
        tokens = read_ranks(file)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """0 and where the bytes of each id end."""
        return np.concatenate([[0], np.cumsum(self.start[ids + 1] - self.start[ids])])

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of many ids, a piece after the other."""
        out = bytearray()
        for k in range(0, len(ids), PIECE_IDS):
            own = ids[k : k + PIECE_IDS]
            ends = self.ends(own)
            out += self.data[np.arange(ends[-1]) + np.repeat(self.start[own] - ends[:-1], np.diff(ends))].tobytes()
        return bytes(out)


@lru_cache(2)
def _decoder(model: str) -> Decoder:
    return Decoder(model_path(model))


@lru_cache(2)
def _bpe(model: str, pattern: str) -> ByteBPE:
    return ByteBPE(model_path(model), pattern)


def default_pattern() -> str:
    """The pattern that splits text before the merges of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, model: str = "byte_bpe_multi_50k.tiktoken", keep: tuple[str, ...] = ("doc_id",), text: str = "text", pattern: str | None = None) -> DataFrame:
    """The columns keep and ids, an array of the token ids of each row's whole text, as the tiktoken library gives them.

    model names a rank file of the public tokenizers, pattern what splits a text (theirs, if None). Null counts as an empty text and
    gives an empty array; every row gives a row, repeated rows included, other columns are left out, and a column of keep called
    ids is refused. An empty table gives an empty result. Nothing is shuffled; a text of any length is one row of one task.
    """
    if "ids" in {k.lower() for k in keep}:
        raise ValueError("a column of keep is called ids, as the result is")
    pattern = pattern or default_pattern()
    schema = extended(df.select(*keep), "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(model, pattern)
        for b in batches:
            texts, a = b.column(len(keep)), 0
            parts: list[np.ndarray] = []
            held = 0
            for k in range(len(b)):
                parts.append(bpe.ids(texts[k].as_py() or ""))
                held += len(parts[-1])
                if held >= BATCH_IDS or k + 1 == len(b):
                    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, k + 1 - a) for c in b.columns[: len(keep)]), ids], names=schema.names)
                    a, held, parts = k + 1, 0, []

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str = "byte_bpe_multi_50k.tiktoken", ids: str = "ids") -> DataFrame:
    """The columns of df and decoded, the bytes (binary) of each row's array of ids: null for a null array, none for an empty one.

    An id that the vocabulary lacks, or a null within an array, is an error. Ids cut from a longer sequence may end within a
    character, which is why the result is binary. A column called decoded is refused; an empty table gives an empty result.
    """
    if "decoded" in {c.lower() for c in df.columns}:
        raise ValueError("there is a column called decoded, as the result is")
    schema, at = extended(df, "decoded binary"), df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _decoder(model)
        for b in batches:
            column = b.column(at)
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("a null among the ids")
            values = flat.to_numpy(zero_copy_only=False)
            if len(values) and not 0 <= values.min() <= values.max() < len(known.start) - 1:
                raise ValueError("an id that the vocabulary lacks")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(known.ends(values)[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64))
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, offsets.buffers()[1], pa.py_buffer(known.decoded(values))]).cast(pa.binary())
            if column.null_count:
                whole = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.binary()), whole)
            yield pa.RecordBatch.from_arrays([*b.columns, whole], names=schema.names)

    return df.mapInArrow(run, schema)
