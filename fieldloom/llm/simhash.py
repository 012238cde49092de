"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import LOWER, NOT_SPACE, Words, blocks, mix, text_arrays
from fieldloom.llm._spark import dropped, extended, free_name, partitions, written
from fieldloom.llm.components import connected_components

_U = np.uint64
#: Rows in a tile of fingerprints, and rows or shingles from which a key's texts are dealt to several tasks.
TILE, DEAL, DEAL_SHINGLES = 512, 4096, 4 << 20
#: Words of 64 bits in the wide fingerprint that tells similarity; bands of min-hashes under which texts meet, min-hashes of a band.
SKETCH, BANDS, ROWS = 8, 10, 4
#: Shingles below which a set counts as small.
SMALL = 40
#: For each byte value, its eight bits as eight byte-wide counters.
_LANES = np.array([sum(((i >> k) & 1) << (8 * k) for k in range(8)) for i in range(256)], dtype=_U)


def fingerprints(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in over half of the XXH64 of its shingles, repeats included.

    Words are maximal runs of other than ASCII white space, with A-Z in lower case. A text of fewer words is one shingle; one
    without words, or null, has the fingerprint zero.
    """
    buf, offsets = text_arrays(column)
    out = np.zeros(len(column), _U)
    for i, j in blocks(offsets):
        out[i:j] = _block(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, seed)
    return out


def _block(buf: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    w = Words(buf, offsets, NOT_SPACE)
    out = np.zeros(len(w.count), _U)
    if not len(w):
        return out
    # words of a document with one space between: drop all separators but the one before each word that is not its document's first
    keep = NOT_SPACE[buf]
    inner = np.ones(len(w), bool)
    inner[w.first[:-1][w.count > 0]] = False
    text = LOWER[buf]
    gap = w.start[inner] - 1
    keep[gap] = True
    text[gap] = 32
    place = np.cumsum(keep)
    start, end = place[w.start] - 1, place[w.end - 1]
    text = text[keep].tobytes()

    first, last, doc, head = _runs(w, shingle)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)], dtype=_U)
    return _majority(h, doc, head)


def _runs(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word and document of each shingle (the whole text where it has fewer words), and each document's first one."""
    n = np.where(w.count > 0, np.maximum(1, w.count - shingle + 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    head = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(head[-1]) - head[doc] + w.first[doc]
    return first, np.minimum(first + shingle, w.first[doc + 1]) - 1, doc, head


def _majority(h: np.ndarray, doc: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each document the bits set in over half of its hashes, counted in byte-wide lanes over at most 255 at a time."""
    n = np.diff(head)
    out = np.zeros(len(n), _U)
    if not len(h):
        return out
    seg = np.flatnonzero((np.arange(len(h)) - head[doc]) % 255 == 0)
    full = np.flatnonzero(n)
    heads = np.searchsorted(seg, head[full])
    ones = np.zeros((len(full), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[(h >> _U(8 * k)) & _U(255)], seg)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads)
    out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(_U).ravel()
    return out


def _shingle_sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (48 bits) and document of the distinct shingles of each document, and each document's first one. Hashes are made from the
    words' own, all at once; a text of fewer words differs from one that repeats its last word."""
    first, last, doc, head = _runs(w, shingle)
    if not len(first):
        return np.zeros(0, _U), doc, head
    h = (last - first).astype(_U)
    for k in range(shingle):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w.hash[np.minimum(first + k, last)] + _U(k))
    h >>= _U(16)
    if len(w.count) <= 1 << 16:  # one sort of documents and hashes together
        both = np.sort((doc.astype(_U) << _U(48)) | h)
        doc, h = (both >> _U(48)).astype(np.int64), both & _U((1 << 48) - 1)
    else:
        h = h[np.lexsort((h, doc))]  # doc is in order already
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    doc = doc[once]
    return h[once], doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(w.count)))])


def _odd(n: int) -> np.ndarray:
    """Odd multipliers, the same at every run."""
    return mix(np.arange(1, n + 1, dtype=_U)) | _U(1)


def sketches(column: pa.Array, shingle: int = 5, words: int = SKETCH, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set of shingles: a wide fingerprint of `words` times 64 bits, the keys of its bands, and its size.

    A band's key joins `rows` min-hashes; two sets agree in it as often as their similarity to this power. Each distinct shingle
    counts once. Texts without words have the fingerprint zero and one key of their own for each band.
    """
    buf, offsets = text_arrays(column)
    bits, keys, size = np.zeros((len(column), words), _U), np.zeros((len(column), bands), _U), np.zeros(len(column), np.int64)
    odd = _odd(bands * rows)
    for i, j in blocks(offsets):
        h, doc, head = _shingle_sets(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE), shingle)
        size[i:j] = np.diff(head)
        for c in range(words):
            bits[i:j, c] = _majority(mix(h + _U(c)), doc, head)
        some = np.flatnonzero(np.diff(head))
        for k in range(bands):
            own = np.full(j - i, _U(k))
            for r in range(k * rows, (k + 1) * rows if len(some) else 0):
                own[some] = mix(own[some] * odd[r] + np.minimum.reduceat((h + odd[-1 - r]) * odd[r], head[some]))
            keys[i:j, k] = own
    return bits, keys, size


def shingle_sets(column: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    buf, offsets = text_arrays(column)
    out = []
    for i, j in blocks(offsets):
        h, _, head = _shingle_sets(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE), shingle)
        out += [h[x:y] for x, y in zip(head[:-1].tolist(), head[1:].tolist(), strict=True)]
    return out


def set_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats; 1 if both are empty."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return float(not len(y))
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return both / (len(x) + len(y) - both)


def similarities(one: pa.Array, other: pa.Array, shingle: int = 5) -> np.ndarray:
    """The Jaccard similarity of the sets of shingles of the texts of each row; 1 where both have no words."""
    (buf, offsets), (buf2, offsets2) = text_arrays(one), text_arrays(other)
    out = np.ones(len(one))
    for i, j in blocks(offsets + offsets2):
        sets = [_shingle_sets(Words(b[o[i] : o[j]], o[i : j + 1] - o[i], NOT_SPACE), shingle) for b, o in ((buf, offsets), (buf2, offsets2))]
        h, doc = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        both = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=j - i)
        every = np.bincount(doc, minlength=j - i) - both
        out[i:j] = np.where(every > 0, both / np.maximum(every, 1), 1.0)
    return out


def with_fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns keep of df, and fp, the fingerprint of text as a signed long."""
    schema = df.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(len(keep)), shingle, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def tile_pairs(bits: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows, as positions, at most radius bits apart within each group; rows are sorted by group.

    Where a group has both sides 0 and 1, only rows of different sides are compared. A group is cut in tiles ordered by population
    count; tile pairs whose counts differ beyond the radius are skipped, the others are compared in full by exclusive-or and bit
    count. Groups that are one small tile each are compared all at once: a row meets the next ones in its tile, in order of their
    counts, until these differ beyond the radius. Of rows of many words, the first four are compared first, with `first` bits.
    """
    head = bits.shape[1] if not first else min(4, bits.shape[1])
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    order = np.lexsort((ones, side, group))
    bits, ones, group, side = bits[order], ones[order], group[order], side[order]
    bound = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(bits) else np.zeros(1, np.int64)
    size = np.diff(bound)
    mixed = side[bound[:-1]] != side[bound[1:] - 1] if len(size) else np.zeros(0, bool)

    def close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= radius
        return x[far], y[far]

    small = (size <= 32) & ~mixed
    stop = np.repeat(np.where(small, bound[1:], 0), size)
    i, d = np.flatnonzero(stop), 0
    while len(i):
        d += 1
        i = i[i + d < stop[i]]
        i = i[ones[i + d] - ones[i] <= radius]
        if len(i):
            x, y = close(i, i + d)
            yield order[x], order[y]
    for g in np.flatnonzero(~small):
        lo, hi = int(bound[g]), int(bound[g + 1])
        mid = lo + int(np.searchsorted(side[lo:hi], 1)) if mixed[g] else hi
        rows = [(s, min(s + TILE, mid)) for s in range(lo, mid, TILE)]
        cols = [(s, min(s + TILE, hi)) for s in range(mid, hi, TILE)] if mixed[g] else rows
        for x0, x1 in rows:
            for y0, y1 in cols:
                if (not mixed[g] and y0 < x0) or ones[y0] - ones[x1 - 1] > radius or ones[x0] - ones[y1 - 1] > radius:
                    continue
                far = np.zeros((x1 - x0, y1 - y0), np.uint16)
                for w in range(head):
                    far += np.bitwise_count(bits[x0:x1, None, w] ^ bits[None, y0:y1, w])
                x, y = np.nonzero(far <= (first or radius))
                x, y = x + x0, y + y0
                once = x < y
                x, y = x[once], y[once]
                if first:
                    x, y = close(x, y)
                yield order[x], order[y]


def linked(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions, of the links that tile_pairs finds between fingerprints of 64 bits."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def forest() -> None:
        nonlocal pairs, held
        x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        used, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        root = _roots(len(used), both[: len(x)], both[len(x) :])
        far = np.flatnonzero(root != np.arange(len(used)))
        pairs, held = [(used[far], used[root[far]])], len(far)

    for x, y in tile_pairs(fp.view(_U)[:, None], group, side, radius):
        pairs.append((x, y))
        held += len(x)
        if held > 1 << 20:
            forest()
    forest()
    return pairs[0]


def key_masks(radius: int, spare: int = 2) -> list[int]:
    """Bit masks such that two fingerprints at most radius bits apart agree on one of them in full: the 64 bits are cut into
    radius + spare blocks, of which at least spare stay untouched."""
    n = radius + spare
    cut = [64 * i // n for i in range(n + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(n)]
    return [sum(block[i] for i in some) for some in combinations(range(n), spare)]


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first `keys` columns of longs."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        rows = np.column_stack([np.asarray(c).astype(np.int64) for c in b.columns[:keys]])
        change = np.flatnonzero((rows[1:] != rows[:-1]).any(1)) + 1
        if last is not None and (last != rows[0]).any():
            change = np.concatenate([[0], change])
        if len(change):
            cut = int(change[-1])
            ready = [*held, b.slice(0, cut)] if cut else held
            if ready:
                yield pa.Table.from_batches(ready)
            held = []
            b = b.slice(cut)
        held.append(b)
        last = rows[-1]
    if held:
        yield pa.Table.from_batches(held)


def _group_numbers(t: pa.Table, keys: int) -> np.ndarray:
    rows = np.column_stack([t.column(k).to_numpy().astype(np.int64) for k in range(keys)])
    return np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1]).any(1)]))


def _dealt(rows: DataFrame, node: str) -> DataFrame:
    """Rows with p, q and side: a key that `parts` is over 1 for is dealt out; its rows are split by hash of the node into parts, and
    each pair of parts is a group of its own, so that no task grows with the key."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).withColumn("side", (F.col("part") > F.col("other")).cast("int"))
    return dealt.drop("part", "other", "parts")


def _met(dealt: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """The keys and other columns, by group."""
    group = [*keys, "p", "q"]
    return dealt.select(*group, *more).repartition(partitions(dealt.sparkSession), *group).sortWithinPartitions(*group)


def fingerprint_links(prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """a, b: links that span each component of the distinct rows whose fingerprints (column fp) are at most radius bits apart.

    Fingerprints meet under keys that lose no link (key_masks) and are compared in tiles there. A key that over DEAL fingerprints
    share is dealt out to several tasks.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(radius, spare)]
    meet = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"))
    crowd = meet.groupBy("mask", "key").count().where("count > 1").select("mask", "key", F.ceil(F.col("count") / DEAL).cast("int").alias("parts"))
    met = _met(_dealt(meet.join(crowd, ["mask", "key"]), "fp"), ["mask", "key"], ["fp", "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 4):
            fp = t.column("fp").to_numpy()
            a, b = linked(fp.copy(), _group_numbers(t, 4), t.column("side").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns keep, fp (signed long), component_id: the smallest doc_id that links of radius bits or fewer reach.

    One row per input row, repeated rows included. Null texts count as empty: they have the fingerprint zero, linked like any
    other. A null doc_id takes part but names no component, so component_id is null only where every reachable doc_id is. An
    empty table gives an empty result; other columns are left out.
    """
    rows = written(with_fingerprint(df, text, tuple(dict.fromkeys((doc_id, *keep))), shingle, seed), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(doc_id).alias("__least"))
    links = fingerprint_links(classes.select("fp"), radius)
    root = connected_components(links)
    joined = classes.join(root, classes["fp"] == root["node"], "left").select("fp", "__least", F.coalesce("root", "fp").alias("__root"))
    least = joined.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return rows.join(joined.join(least, "__root").select("fp", "component_id"), "fp").select(*rows.columns, "component_id")


def allowed_bits(similarity: float, bits: int, above: float, small: bool = False) -> int:
    """Bits of a wide fingerprint in which two sets of a similarity (Jaccard) may differ.

    Sets of equal size and similarity s form an angle of arccos(2s / (1 + s)), others a smaller one; so many of the bits differ on
    average, to which some standard deviations are added. In small sets majorities are often close: a fifth of the bits more.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) * (1.25 if small else 1)
    return int(np.floor(bits * share + above * np.sqrt(bits * share * (1 - share))))


class Alikeness:
    """Which pairs of one group may be alike, by wide fingerprints, each pair in the first band that the two share."""

    def __init__(self, t: pa.Table, keys: int, similarity: float):
        self.key = t.column("key").to_numpy().view(_U)
        self.group, self.side = _group_numbers(t, keys), t.column("side").to_numpy()
        self.bits = _matrix(t.column("bits"))
        self.bands = _matrix(t.column("bands"))
        self.size = t.column("size").to_numpy()
        self.apart = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
        width = 64 * self.bits.shape[1]
        self.radius, self.tight = (allowed_bits(similarity, width, 2.5, s) for s in (True, False))
        self.first = allowed_bits(similarity, 256, 4.5, True)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in tile_pairs(self.bits, self.group, self.side, self.radius, self.first):
            use = self.apart[x] != self.apart[y]
            x, y = x[use], y[use]
            if not len(x):
                continue
            use = close_sets(self.bits[x], self.bits[y], np.minimum(self.size[x], self.size[y]), self.radius, self.tight)
            x, y = x[use], y[use]
            same = self.bands[x] == self.bands[y]
            use = self.bands[x, same.argmax(1)] == self.key[x]
            yield x[use], y[use]


def close_sets(one: np.ndarray, other: np.ndarray, size: np.ndarray, radius: int, tight: int) -> np.ndarray:
    """Whether fingerprints are as close as those of alike sets, of which the smaller has so many members."""
    return np.bitwise_count(one ^ other).sum(1, dtype=np.int64) <= np.where(size < SMALL, radius, tight)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of byte strings of one length as rows of unsigned longs."""
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _set_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, _U)


def confirmed(a: Alikeness, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that join what is apart: pairs that may be alike are compared exactly, unless links found before join
    them already."""
    label = a.apart.copy()
    ends: list[tuple[int, int]] = []
    for x, y in a.pairs():
        for i in range(0, len(x), 4096):
            u, v = x[i : i + 4096], y[i : i + 4096]
            use = label[u] != label[v]
            found = [(m, n) for m, n in zip(u[use].tolist(), v[use].tolist(), strict=True) if set_similarity(sets[m], sets[n]) >= similarity]
            if found:
                ends += found
                m, n = (label[np.array(e)] for e in zip(*found, strict=True))
                label = _roots(int(label.max()) + 1, m, n)[label]
    return (np.array(e, np.int64) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2


def alike(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) between texts (__th, __text) whose sets of shingles have a Jaccard similarity of at least so much."""
    ends = links.select(F.col("a").alias("__th")).union(links.select("b")).distinct()
    own = written(texts.join(ends, "__th", "left_semi").dropDuplicates(["__th"]), "linked-texts")
    pairs = links.join(own.select(F.col("__th").alias("a"), F.col("__text").alias("__one")), "a").join(own.select(F.col("__th").alias("b"), F.col("__text").alias("__other")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(similarities(batch.column(2), batch.column(3), shingle) >= similarity))

    held = written(pairs.select("a", "b", "__one", "__other").mapInArrow(run, "a long, b long"), "alike")
    dropped(own)
    return held


def similar_components(classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root: components of the texts (classes: __th, bits, bands, size) whose shingle sets are alike.

    Texts meet under the keys of their bands. First each is compared with one text of each key, so that a group of many near
    copies becomes one component by as many comparisons as it has texts. Keys under which texts of several components meet are then
    compared in tiles, all pairs of texts from different ones; those that may be alike are compared exactly in the task.
    """
    radius, tight = (allowed_bits(similarity, 64 * SKETCH, 2.5, s) for s in (True, False))
    every = classes.select("__th", "size", F.explode("bands").alias("key"))
    crowd = every.groupBy("key").agg(F.count("*").alias("n"), F.min_by("__th", F.xxhash64("__th", "key")).alias("pivot")).where("n > 1")
    keys = written(every.join(crowd.select("key", "pivot"), "key"), "keys")

    # every text with one of each key
    bits = classes.select("__th", "bits", "size")
    pairs = keys.where("__th <> pivot").select(F.least("__th", "pivot").alias("a"), F.greatest("__th", "pivot").alias("b")).distinct()
    pairs = pairs.join(bits.toDF("a", "one", "n_one"), "a").join(bits.toDF("b", "other", "n_other"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                one, other = (_matrix(pa.chunked_array([b.column(c)])) for c in ("one", "other"))
                size = np.minimum(b.column("n_one").to_numpy(), b.column("n_other").to_numpy())
                yield b.select(["a", "b"]).filter(pa.array(close_sets(one, other, size, radius, tight)))

    links = written(pairs.select("a", "b", "one", "other", "n_one", "n_other").mapInArrow(near, "a long, b long"), "candidates")
    sure = alike(links, texts, shingle, similarity)
    root = connected_components(sure)

    # all pairs of different components under a key
    own = keys.select("__th", "size", "key").join(root, F.col("__th") == F.col("node"), "left").select("__th", "size", "key", F.coalesce("root", "__th").alias("comp"))
    several = own.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    several = several.select("key", F.greatest(F.ceil(F.col("n") / DEAL), F.ceil(F.col("all") / DEAL_SHINGLES)).cast("int").alias("parts"))
    packed = classes.select("__th", "bits", F.col("packed").alias("bands"))
    more = ["__th", "side", "comp", "size", "bits", "bands"]
    met = _met(_dealt(own.join(several, "key").join(packed, "__th"), "__th"), ["key"], more)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 3):
            hit = np.zeros(len(t), bool)
            for x, y in Alikeness(t, 3, similarity).pairs():
                hit[x] = hit[y] = True
            yield from t.select(["key", "p", "q", "__th", "side", "comp", "size"]).filter(pa.array(hit)).to_batches()

    flagged = written(met.mapInArrow(flag, "key long, p int, q int, __th long, side int, comp long, size long"), "flagged")
    some = texts.join(flagged.select("__th").distinct(), "__th", "left_semi").dropDuplicates(["__th"])

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), shingle)], pa.binary())], names=["__th", "set"])

    sets = written(some.select("__th", "__text").mapInArrow(as_sets, "__th long, set binary"), "sets")
    met = _met(flagged.join(packed, "__th").join(sets, "__th"), ["key"], [*more, "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 3):
            node = t.column("__th").to_numpy()
            a, b = confirmed(Alikeness(t, 3, similarity), [_set_of(v) for v in t.column("set").to_pylist()], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    rest = written(met.mapInArrow(verify, "a long, b long"), "confirmed")
    out = connected_components(sure.union(rest))
    dropped(keys, links, flagged, sets, root, sure, rest)
    return out


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df, with all their columns, of which one stands for each group of near-duplicates: that with the smallest doc_id
    (null last), then the smallest hash of its text; of rows alike in both, one. Null texts count as empty; texts without words are
    alike. An empty table gives an empty result.

    Groups are components of links between texts whose sets of `shingle`-word shingles have the given similarity (Jaccard) or more,
    compared exactly. Candidates agree in a band of min-hashes (at a similarity of 0.8, 99.5 % of pairs do; above, more), and their
    wide fingerprints, compared in tiles, are as close as those of sets with that similarity (within two and a half standard deviations).
    Exact copies are one text from the start.
    """
    texts = df.select(F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"), F.col(text).alias("__text"))
    schema = extended(texts.select("__id", "__th"), "bits binary, packed binary, bands array<long>, size long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, keys, size = sketches(b.column(2), shingle)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(bits), _binary(keys), bands, pa.array(size)], names=schema.names)

    rows = written(texts.mapInArrow(run, schema), "sketches")
    rank = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__th").alias("th"))
    # what a text's sketch holds depends on the text alone
    classes = written(rows.groupBy("__th").agg(F.min(rank).alias("__least"), *[F.any_value(c).alias(c) for c in ("bits", "packed", "bands", "size")]), "texts")
    dropped(rows)
    root = similar_components(classes, texts.select("__th", F.coalesce("__text", F.lit("")).alias("__text")), shingle, similarity)
    joined = classes.join(root, classes["__th"] == root["node"], "left").select("__least", F.coalesce("root", "__th").alias("__root"))
    chosen = joined.groupBy("__root").agg(F.min("__least").alias("w")).select(F.coalesce(F.col("w.id").cast("string"), F.lit("")).alias("__wid"), F.col("w.th").alias("__wth"))
    # ids are long or string; the two parts together name one text, and of its equal rows the first stays
    wid, wth = free_name(df, "__wid"), free_name(df, "__wth")
    keyed = df.withColumn(wid, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).withColumn(wth, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(chosen.toDF(wid, wth), [wid, wth], "left_semi").dropDuplicates([wid, wth]).drop(wid, wth)
