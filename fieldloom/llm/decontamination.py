"""Benchmark decontamination: documents joined with benchmark windows on each window's rarest shingle, then verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import ALNUM, LOWER, Words, blocks, mix, text_arrays
from fieldloom.llm._spark import extended, free_name

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]
#: Bytes of benchmark text in one index; a larger benchmark is held as several, which executors load one after the other.
INDEX_BYTES = 16 << 20


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the shingle of so many words that starts at each word; the last size - 1 words start none."""
    n = max(0, len(h) - size + 1)
    total = np.full(n, _U(size))
    for k in range(size):
        total += mix(h[k : k + n] * _ODD[k])
    return mix(total)


@dataclass
class Lookup:
    """Sorted 64-bit keys behind a bitmap on their low bits."""

    keys: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Lookup:
        keys = np.unique(keys)
        bits = np.zeros(1 << max(16, int(len(keys) * 32).bit_length()), bool)
        bits[keys & _U(len(bits) - 1)] = True
        return cls(keys, bits)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hold a key, and which."""
        at = np.flatnonzero(self.bitmap[h & _U(len(self.bitmap) - 1)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


class Windows:
    """The windows of some items: `window` consecutive words, or all words of an item that has fewer.

    Shingles of up to `shingle` words are ordered by how often the documents hold them. Since a window must be contained in
    full, the necessary prefix of its ordered shingles is the rarest one alone; that and its place in the window is the key.
    """

    def __init__(self, ids: list, texts: list, window: int, shingle: int):
        buf, offsets = text_arrays(pa.array(texts, pa.large_string()))
        w = Words(buf, offsets, ALNUM)
        self.ids, self.shingle = ids, shingle
        self.hash, self.data, self.start, self.end = w.hash, LOWER[buf], w.start, w.end
        size = np.minimum(w.count, window)
        n = np.where(w.count > 0, w.count - size + 1, 0)
        self.item = np.repeat(np.arange(len(n)), n)
        head = np.concatenate([[0], np.cumsum(n)])[:-1]
        self.first = w.first[:-1][self.item] + np.arange(len(self.item)) - head[self.item]  # in the items' words
        self.size = size[self.item]
        self.sizes = sorted({min(shingle, int(x)) for x in set(self.size.tolist())})
        self.by_size = {s: _shingles(w.hash, s) for s in self.sizes}
        self.counted: dict[int, Lookup] = {}
        for s in self.sizes:
            rows = np.flatnonzero(np.minimum(self.size, shingle) == s)
            at = np.unique(np.concatenate([self.first[rows] + k for k in range(window - s + 1)])) if len(rows) else rows
            self.counted[s] = Lookup.of(self.by_size[s][at[at < len(self.by_size[s])]])

    def count(self, w: Words) -> dict[int, np.ndarray]:
        """How often the words hold each shingle of `counted`."""
        out = {}
        for s, lookup in self.counted.items():
            at, k = lookup.find(_shingles(w.hash, s))
            at_doc = np.searchsorted(w.first, at, "right")
            inside = at + s <= w.first[np.minimum(at_doc, len(w.first) - 1)]
            out[s] = np.bincount(k[inside], minlength=len(lookup.keys))
        return out

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Takes each window's rarest shingle, the first of equals, as its key."""
        self.lookup, self.order, self.bound, self.place = {}, {}, {}, {}
        for s in self.sizes:
            rows = np.flatnonzero(np.minimum(self.size, self.shingle) == s)
            best = np.full(len(rows), np.iinfo(np.int64).max)
            place = np.zeros(len(rows), np.int64)
            for k in range(int(self.size[rows].max()) - s + 1):
                fits = np.flatnonzero(k + s <= self.size[rows])
                n = counts[s][np.searchsorted(self.counted[s].keys, self.by_size[s][self.first[rows[fits]] + k])]
                fewer = fits[n < best[fits]]
                best[fewer], place[fewer] = n[n < best[fits]], k
            key = self.by_size[s][self.first[rows] + place]
            order = np.argsort(key, kind="stable")
            self.lookup[s] = Lookup.of(key)
            self.order[s], self.place[s] = rows[order], place[order]
            self.bound[s] = np.searchsorted(key[order], self.lookup[s].keys)
            self.bound[s] = np.concatenate([self.bound[s], [len(order)]])
        del self.by_size, self.counted

    def find(self, w: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: first word, window. `data` holds the folded bytes that the words point into."""
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in self.sizes:
            at, k = self.lookup[s].find(_shingles(w.hash, s))
            lo, n = self.bound[s][k], self.bound[s][k + 1] - self.bound[s][k]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(lo, n) + step
            win, at = self.order[s][row], np.repeat(at, n) - self.place[s][row]
            doc = np.searchsorted(w.first, at + self.place[s][row], "right") - 1
            fits = (at >= w.first[doc]) & (at + self.size[win] <= w.first[doc + 1])  # bounds on place and length
            at, win = at[fits], win[fits]
            for k in range(int(self.size[win].max(initial=0))):  # words in turn; few candidates outlive the first
                more = k < self.size[win]
                same = ~more
                same[more] = w.hash[at[more] + k] == self.hash[self.first[win[more]] + k]
                at, win = at[same], win[same]
            found_at.append(at)
            found.append(win)
        at, win = np.concatenate(found_at), np.concatenate(found)
        if len(at):
            exact = self._exact(w, data, at, win)
            at, win = at[exact], win[exact]
        return at, win

    def _exact(self, w: Words, data: np.ndarray, at: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Compares the bytes of words of equal hash, each once."""
        n = self.size[win]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mine, theirs = np.repeat(at, n) + step, np.repeat(self.first[win], n) + step
        words, once = np.unique(mine, return_index=True)
        theirs_once = theirs[once]
        a, b = w.start[words], self.start[theirs_once]
        size = w.end[words] - a
        bad = size != self.end[theirs_once] - b
        ok = np.flatnonzero(~bad)
        size, a, b = size[ok], a[ok], b[ok]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = data[np.repeat(a, size) + step] != self.data[np.repeat(b, size) + step]
        if len(differ):
            bad[ok] = np.add.reduceat(differ, np.cumsum(size) - size) > 0
        if not bad.any():
            return np.ones(len(at), bool)
        wrong = set(words[bad].tolist())  # a hash collision: compare these occurrences word by word
        words_of = lambda d, s, e, i, m: [d[s[j] : e[j]].tobytes() for j in range(i, i + m)]
        return np.array([not wrong & set(range(i, i + m)) or words_of(data, w.start, w.end, i, m) == words_of(self.data, self.start, self.end, int(self.first[x]), m) for i, m, x in zip(at.tolist(), n.tolist(), win.tolist(), strict=True)])


def _loaded(index):
    """The value of a broadcast, not kept in the worker, so that a worker holds one part of a large benchmark at a time."""
    value = index.value
    if hasattr(index, "_value") and getattr(value, "several", False):
        del index._value
    return value


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text: str, window: int, shingle: int) -> list:
    """Broadcast parts of the benchmark's index, each of about INDEX_BYTES of text, with shingle counts over all documents."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("text <> ''")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(-(-total // INDEX_BYTES))
    out = []
    for part in range(parts):
        own = sorted(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect(), key=lambda r: (r["id"] is not None, r["id"], r["text"]))
        index = Windows([r["id"] for r in own], [r["text"] for r in own], window, shingle)
        if not len(index.item):
            continue
        index.several = parts > 1
        sent = spark.sparkContext.broadcast(index)

        def tally(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, total = sent.value, None
            for b in batches:
                buf, offsets = text_arrays(b.column(0))
                for i, j in blocks(offsets):
                    found = index.count(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM))
                    total = found if total is None else {s: total[s] + n for s, n in found.items()}
            for s, n in (total or {}).items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s)), pa.array(k), pa.array(n[k].astype(np.int64))], names=["size", "k", "n"])

        counts = {s: np.zeros(len(x.keys), np.int64) for s, x in index.counted.items()}
        for size, k, n in docs.select(F.col(text).alias("__text")).mapInArrow(tally, "size long, k long, n long").groupBy("size", "k").agg(F.sum("n").alias("n")).collect():  # at most one row for each shingle of this part
            counts[size][k] = n
        sent.unpersist()
        index.choose(counts)
        out.append(spark.sparkContext.broadcast(index))
    return out


def _scan(column: pa.Array, indexes: list) -> Iterator[tuple[Words, np.ndarray, list[list], np.ndarray]]:
    """For each block of rows: its words, the mask of hit words, the item ids of each row, and the offsets."""
    buf, offsets = text_arrays(column)
    for i, j in blocks(offsets):
        raw, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = Words(raw, own, ALNUM)
        edge = np.zeros(len(w) + 1, np.int64)
        items: list[set] = [set() for _ in range(j - i)]
        data = LOWER[raw]
        for sent in indexes:
            index = _loaded(sent)
            at, win = index.find(w, data)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + index.size[win], -1)
            doc = np.searchsorted(w.first, at, "right") - 1
            for d, x in set(zip(doc.tolist(), index.item[win].tolist(), strict=True)):
                if index.ids[x] is not None:
                    items[d].add(index.ids[x])
        yield w, np.cumsum(edge)[:-1] > 0, [sorted(x) for x in items], own


def _hits(w: Words, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[w.first[1:]] - total[w.first[:-1]]


def contamination(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3) -> DataFrame:
    """The columns keep, n_words, n_hit, items (array of the ids, as sorted strings, of items with a window in the text), and
    runs (array of [first, end) word ranges hit).

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A null text has no words; an
    empty item or benchmark has no window; repeated items count once and an item with a null id hits words but is not listed.
    Every input row gives a row, repeated rows included.
    """
    indexes = _indexes(docs, items, item_id, item_text, text, window, shingle)
    schema = extended(docs.select(*keep), "n_words long, n_hit long, items array<string>, runs array<struct<first:int,end:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            n_words, n_hit, names, runs = [], [], [], []
            for w, hit, items_of, _ in _scan(b.column(len(keep)), indexes):
                hits = _hits(w, hit)
                n_words += w.count.tolist()
                n_hit += hits.tolist()
                names += items_of
                for d, n in enumerate(hits.tolist()):
                    own = hit[w.first[d] : w.first[d + 1]] if n else hit[:0]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) if n else own
                    runs.append([{"first": x, "end": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(runs, kind)], names=[*keep, "n_words", "n_hit", "items", "runs"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, share: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated: no word hit, or share * n_hit < n_words."""
    indexes = _indexes(docs, items, item_id, item_text, text, window, shingle)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for w, hit, _, _ in _scan(b.column(b.num_columns - 1), indexes):
                n = _hits(w, hit)
                clean.append((n == 0) | (share * n < w.count))
            kept = b.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return docs.select("*", F.col(text).alias(free_name(docs, "__text"))).mapInArrow(run, docs.schema)
