"""Periodic runs of words: classes of positions with equal factors, refined by length, show squares that merge into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import NOT_SPACE, Words, blocks, text_arrays
from fieldloom.llm._spark import extended

#: Bytes of text that are hashed together, to see which documents may hold a run.
BLOCK = 1 << 21
#: Bytes of collapsed text that one output batch holds, unless a single text has more.
BATCH_BYTES = 1 << 24
Run = tuple[int, int, int]


def runs(words: list, least: int = 24, times: int = 3) -> list[Run]:
    """The runs of a sequence as (start, length, period), by start, then period: stretches with smallest period q of at least
    max(least, times * q) words that no neighbouring word extends. times is 3 or more.

    Crochemore's refinement: two positions are in one class of length l if the l words from there on are the same. Classes of
    length l + 1 follow by splitting those of positions i by the class of i + 1; of the parts of a class, the largest need not
    split others, so all refinement takes n log n steps. Neighbours of a class at distance l show a square of period l. Squares
    of one period that overlap are one run, whose ends are then told word by word.

    A run has three equal factors of each length up to its period, so classes of fewer than three positions end at once; they
    still split others, once. So do lengths beyond n / times, which no period reaches.
    """
    n = len(words)
    found: list[Run] = []
    if n < least:
        return found
    by_word: dict = {}
    for i, w in enumerate(words):
        by_word.setdefault(w, []).append(i)
    group = [-1] * (n + 1)
    before, after = [-1] * (n + 1), [-1] * (n + 1)
    head: list[int] = []
    size: list[int] = []
    gaps: dict[int, list[int]] = {}

    def settle(members: list[int], level: int) -> None:
        """Makes a class of members, in rising order; too few of them belong to none."""
        if len(members) < 3:
            for i in members:
                group[i] = -1
            return
        c, last = len(head), -1
        head.append(members[0])
        size.append(len(members))
        for i in members:
            group[i] = c
            before[i] = last
            if last >= 0:
                after[last] = i
                if i - last >= level:
                    gaps.setdefault(i - last, []).append(last)
            last = i
        after[last] = -1

    splitting = [[n]]
    largest = max(by_word.values(), key=len)
    for members in by_word.values():
        settle(members, 1)
        if members is not largest:
            splitting.append(members)
    root, reach = [0] * n, [0] * n
    code = {w: k for k, w in enumerate(by_word)}
    ids = [code[w] for w in words]
    most = n // times
    for level in range(1, most + 1):
        if level > 1:
            splitting = _refined(level, splitting, group, before, after, head, size, gaps, settle)
        for i in sorted(gaps.pop(level, ())):
            if group[i] < 0 or after[i] != i + level or root[i] and level % root[i] == 0 and i + 2 * level <= reach[i]:
                continue  # no square any more, or one within a run of this period or of a part of it
            a, b = i, i + 2 * level
            while a > 0 and ids[a - 1] == ids[a - 1 + level]:
                a -= 1
            while b < n and ids[b] == ids[b - level]:
                b += 1
            squares = b - 2 * level + 1 - a
            root[a : a + squares] = [level] * squares
            reach[a : a + squares] = [b] * squares
            if b - a >= max(least, times * level):
                found.append((a, b - a, level))
        if not splitting and not gaps:
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def _refined(level: int, splitting: list[list[int]], group: list[int], before: list[int], after: list[int], head: list[int], size: list[int], gaps: dict, settle) -> list[list[int]]:
    """Makes the classes of length level out of those one shorter; returns those that split others at the next length."""
    parts: dict[int, list[list[int]]] = {}
    for members in splitting:
        made: dict[int, list[int]] = {}
        for p in members:
            i = p - 1
            if i < 0 or (c := group[i]) < 0:
                continue
            a, b = before[i], after[i]
            if a >= 0:
                after[a] = b
            else:
                head[c] = b
            if b >= 0:
                before[b] = a
                if a >= 0 and b - a >= level:
                    gaps.setdefault(b - a, []).append(a)
            size[c] -= 1
            made.setdefault(c, []).append(i)
        for c, m in made.items():
            parts.setdefault(c, []).append(m)
    out: list[list[int]] = []
    for c, of_class in parts.items():
        rest = size[c]
        if not rest and len(of_class) == 1:
            settle(of_class[0], level)  # all of the class moved together: it is not split
            continue
        big = max(range(len(of_class)), key=lambda k: len(of_class[k]))
        whole = rest >= len(of_class[big])
        for k, m in enumerate(of_class):
            settle(m, level)
            if whole or k != big:
                out.append(m)
        if rest and (not whole or rest < 3):
            left, i = [], head[c]
            while i >= 0:
                left.append(i)
                i = after[i]
            if rest < 3:
                for i in left:
                    group[i] = -1
            if not whole:
                out.append(left)
    return out


def kept_words(n: int, found: list[Run]) -> list[tuple[int, int]]:
    """The stretches of words, start and end, that stay when of each run only its first period does."""
    out, at = [], 0
    for a, b in sorted((s + q, s + length) for s, length, q in found):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < n:
        out.append((at, n))
    return out


def _suspects(buf: np.ndarray, offsets: np.ndarray, least: int, times: int) -> np.ndarray:
    """The documents in which some sequence of `width` words occurs three times, by its hash; only they can hold a run.

    A run of period q has equal factors of `width` words at its start and q and 2q words later: it reaches at least
    max(least, times * q) words, and width is the most for which 2q + width stays within that for every q.
    """
    width = max(1, -(-least // times))
    w = Words(buf, offsets, NOT_SPACE, fold=np.arange(256, dtype=np.uint8))
    if len(w) < least:
        return np.zeros(0, np.int64)
    h, done = w.hash, 1
    with np.errstate(over="ignore"):
        while done < width:
            step = min(done, width - done)
            nxt = np.zeros_like(h)
            nxt[:-step] = h[step:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + nxt * np.uint64(0x94D049BB133111EB) + np.uint64(step)
            done += step
        doc = w.document()
        inside = np.arange(len(w)) + width <= w.first[1:][doc]
        doc, h = doc[inside], h[inside]
        h = h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    h = h[order]
    return np.unique(doc[order[:-2][h[2:] == h[:-2]]])


def find_runs(df: DataFrame, least: int = 24, times: int = 3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep, runs (array of start, length and period, in words, by start, then period) of each row's whole text, and
    collapsed, the text's words joined by one space without those that repeat a run's first period.

    Words are `[^\\x20\\x09-\\x0D]+`. Null counts as an empty text: no runs, collapsed empty. Every row gives a row, repeated rows
    included; other columns are left out, a column of keep called runs or collapsed is refused, and an empty table gives an empty
    result. Nothing is shuffled; memory and time grow as n and n log n of a text's n words, which one task holds.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    if {"runs", "collapsed"} & {k.lower() for k in keep}:
        raise ValueError("a column of keep is called as a result is")
    schema = extended(df.select(*keep), "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_arrays(b.column(len(keep)))
            first, held, all_runs, texts = 0, 0, [], []
            for i, j in blocks(offsets, BLOCK):
                raw, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                suspects = set(_suspects(raw, own, least, times).tolist())
                for d in range(j - i):
                    words = raw[own[d] : own[d + 1]].tobytes().split()  # bytes part at the same six characters
                    found = runs(words, least, times) if d in suspects else []
                    if found:
                        words = [w for x, y in kept_words(len(words), found) for w in words[x:y]]
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(words))
                    held += len(texts[-1])
                    if held >= BATCH_BYTES or i + d + 1 == len(b):
                        keys = [c.slice(first, len(texts)) for c in b.columns[: len(keep)]]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(all_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)
                        first, held, all_runs, texts = first + len(texts), 0, [], []

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def strongest(found: Column) -> Column:
    """The run of greatest length to period, compared exactly; of equal ones the one of smallest start, then period; null for none."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]  # noqa: E731  the array is ordered by start and period
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def made_periodic(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with a tenth of its texts, chosen by a checksum of the id, made periodic from some word on; they lose other spaces.

    Of n words, with h the checksum and g = h / 10, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) / (3 + g % 8), all whole numbers. Texts without words, null ones and those of null ids stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10)

    def made(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")

    chosen = (h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return df.withColumn(text, F.when(chosen, F.element_at(F.transform(F.array(words), made), 1)).otherwise(F.col(text)))
