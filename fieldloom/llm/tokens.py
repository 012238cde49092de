"""Token counts of a byte-pair vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import Words, blocks, text_arrays
from fieldloom.llm._spark import extended

_FAR = np.iinfo(np.int32).max
#: Words remembered in one worker, by a 64-bit hash.
CACHE = 2_000_000
#: Symbols that one round of merging holds at most, unless a single run of text has more.
SYMBOLS = 1 << 16


def model_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """An open-addressing table from 64-bit keys to their positions, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(10, int(len(keys) * 4).bit_length()))
        self.key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.at = np.full(len(self.key), -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            self.key[slot[free]] = keys[todo[free]]
            lost = self.key[slot] != keys[todo]
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, at = self.key[slot], self.at[slot]
        todo = np.flatnonzero((found != keys) & (at >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.key) - 1)
            found[todo], at[todo] = self.key[slot], self.at[slot]
            more = (found[todo] != keys[todo]) & (at[todo] >= 0)
            todo, slot = todo[more], slot[more]
        return np.where(found == keys, at, -1)


class PieceVocabulary:
    """What merging needs to know of a sentencepiece BPE model: the symbol of each character and, for each pair of symbols
    that make a piece, the piece and its rank (0 is merged first)."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        self.normalize = sp.normalize
        # anything but putting one mark in front and for each blank is left to the library's own normaliser
        self.custom = sp.normalize(" a  ﬁ\t①\u3000") != "▁▁a▁▁ﬁ\t①\u3000"
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        order = {x: k for k, x in enumerate(sorted(set(rank.values())))}
        ids = {piece: k for k, piece in enumerate(rank)}
        chars = sorted({c for piece in rank for c in piece})
        # characters that only occur within pieces are symbols as well: they may be merged, and fall back to bytes if left over
        for c in chars:
            ids.setdefault(c, len(ids))
        self.char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.char[ord(c)] = ids[c]
        self.whole = np.zeros(len(ids) + 1, bool)
        self.whole[[ids[p] for p in rank]] = True
        self.rank = np.full(len(ids), _FAR, np.int32)
        pairs = []
        for piece, r in rank.items():
            self.rank[ids[piece]] = order[r]
            for k in range(1, len(piece)):
                if (a := ids.get(piece[:k])) is not None and (b := ids.get(piece[k:])) is not None:
                    pairs.append((a << 32 | b, ids[piece]))
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.merged = np.array([m for _, m in pairs], np.int32)
        self.pairs = _Table(self.pair)
        # a text can be cut wherever no piece holds the two characters together
        bigrams = {piece[k : k + 2] for piece in rank for k in range(len(piece) - 1)}
        self.bigram = np.unique(np.array([int(self.char[ord(x[0])]) << 32 | int(self.char[ord(x[1])]) for x in bigrams], np.int64))
        self.bigrams = _Table(self.bigram)
        self.words_apart = not any(re.search("[^▁]▁", piece) for piece in rank)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        k = self.pairs.find(a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF))
        return np.where(k >= 0, self.merged[k], np.int32(-1))

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two characters next to each other."""
        return self.bigrams.find(a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)) >= 0

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text, in which white space is already the vocabulary's mark."""
        size = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.char[points]
        n_bytes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        text = np.repeat(np.arange(len(texts)), size)
        out = np.zeros(len(texts), np.int64)
        if not len(points):
            return out
        cut = np.ones(len(points), bool)
        cut[1:] = (text[1:] != text[:-1]) | ~self.together(symbol[:-1], symbol[1:])
        starts = np.flatnonzero(cut)
        left = 0
        while left < len(starts):  # sequences of about SYMBOLS symbols together
            right = max(left + 1, int(np.searchsorted(starts, starts[left] + SYMBOLS)))
            lo, hi = int(starts[left]), int(starts[right]) if right < len(starts) else len(points)
            seq = np.cumsum(cut[lo:hi]) - 1
            kept, where = self._merged(symbol[lo:hi], seq)
            cost = np.where(self.whole[kept], 1, n_bytes[lo:hi][where])
            out += np.bincount(text[lo:hi][where], weights=cost, minlength=len(texts)).astype(np.int64)
            left = right
        return out

    def _merged(self, symbol: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when nothing can be merged, and the place of the first character of each.

        In each round every sequence finds its lowest rank and joins all its pairs of that rank at once, from the left where
        they overlap. Where joining makes a pair of a still lower rank next to one that waits for its turn, one at a time could
        give another result; such a sequence joins only its leftmost pair in that round.
        """
        done_s, done_w = [], []
        where = np.arange(len(symbol))
        while len(symbol):
            same = seq[1:] == seq[:-1]
            made = np.full(len(symbol), -1, np.int32)
            made[:-1][same] = self.joined(symbol[:-1][same], symbol[1:][same])
            rank = np.where(made >= 0, self.rank[made], _FAR)
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(symbol)))
            over = np.repeat(low == _FAR, size)
            if over.any():  # sequences that are finished leave
                done_s.append(symbol[over])
                done_w.append(where[over])
                rest = ~over
                symbol, where, seq, made, rank = symbol[rest], where[rest], seq[rest], made[rest], rank[rest]
                if not len(symbol):
                    break
                open_ = low != _FAR
                low, size = low[open_], size[open_]
                head = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = rank == np.repeat(low, size)
            at = np.flatnonzero(hit)
            # of neighbouring hits every second one, from the left
            new_run = np.concatenate([[True], np.diff(at) > 1])
            run = np.cumsum(new_run) - 1
            at = at[(at - at[new_run][run]) % 2 == 0]
            take = np.zeros(len(symbol), bool)
            take[at] = True
            symbol_new = symbol.copy()
            symbol_new[at] = made[at]
            keep = ~np.concatenate([[False], take[:-1]])
            s2, q2 = symbol_new[keep], seq[keep]
            if len(at) > len(head):  # some sequence joins several pairs: is a lower rank made beside one?
                t2 = take[keep]
                pair = np.flatnonzero((q2[1:] == q2[:-1]) & (t2[1:] | t2[:-1]))
                m = self.joined(s2[pair], s2[pair + 1])
                index = np.cumsum(np.concatenate([[0], (q2[1:] != q2[:-1]).astype(np.int64)]))
                bad = np.unique(index[pair[(m >= 0) & (np.where(m >= 0, self.rank[m], _FAR) <= low[index[pair]])]])
                if len(bad):
                    of = np.repeat(np.arange(len(head)), size)
                    first = np.unique(of[at], return_index=True)[1]
                    single = np.ones(len(at), bool)
                    single[np.isin(of[at], bad)] = False
                    single[first] = True
                    at = at[single]
                    take[:] = False
                    take[at] = True
                    symbol_new = symbol.copy()
                    symbol_new[at] = made[at]
                    keep = ~np.concatenate([[False], take[:-1]])
                    s2, q2 = symbol_new[keep], seq[keep]
            symbol, seq, where = s2, q2, where[keep]
        return np.concatenate([*done_s, np.zeros(0, np.int32)]).astype(np.int64), np.concatenate([*done_w, np.zeros(0, np.int64)]).astype(np.int64)


_NOT_BLANK = np.arange(256) != 32
_AS_IS = np.arange(256, dtype=np.uint8)


@lru_cache(2)
def vocabulary(file: str) -> PieceVocabulary:
    return PieceVocabulary(file)


#: For each file, the hashes of words seen, in order, and their tokens.
_seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _known(v: PieceVocabulary, file: str, hashes: np.ndarray, spell) -> np.ndarray:
    """The tokens of words with distinct, sorted hashes; spell(positions) gives the words not seen before."""
    keys, counts = _seen.get(file, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    place = np.searchsorted(keys, hashes)
    near = np.minimum(place, len(keys) - 1)
    had = keys[near] == hashes if len(keys) else np.zeros(len(hashes), bool)
    out = np.zeros(len(hashes), np.int32)
    out[had] = counts[near[had]] if len(keys) else 0
    new = np.flatnonzero(~had)
    if len(new):
        out[new] = v.count(spell(new))
        if len(keys) + len(new) > CACHE:
            keys, counts, new, place = keys[:0], counts[:0], np.arange(len(hashes)), np.zeros(len(hashes), np.int64)
        _seen[file] = np.insert(keys, place[new], hashes[new]), np.insert(counts, place[new], out[new])
    return out


def token_counts(column: pa.Array, file: str) -> np.ndarray:
    """The tokens of each text as the library counts them, without added special tokens; null counts as empty."""
    v = vocabulary(file)
    buf, offsets = text_arrays(column)
    out = np.zeros(len(column), np.int64)
    for i, j in blocks(offsets):
        raw, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        data = raw.tobytes()
        if not v.words_apart or v.custom:
            out[i:j] = v.count([v.normalize(data[a:b].decode()) if b > a else "" for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
            continue
        w = Words(raw, own, _NOT_BLANK, _AS_IS)
        # marks before each word: its blanks, and the one put before every text; a word with one mark is looked up by its hash
        last = np.concatenate([[0], w.end[:-1]])
        first = w.first[:-1][w.count > 0]
        last[first] = own[:-1][w.count > 0] - 1
        marks = w.start - last
        plain = marks == 1
        odd_doc, odd = [], []
        if b"\xe2\x96\x81" in data:  # texts that spell the mark itself
            has = np.array([b"\xe2\x96\x81" in data[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
            for d in np.flatnonzero(has).tolist():
                odd_doc.append(d)
                odd.append("▁" + data[own[d] : own[d + 1]].decode().replace(" ", "▁"))
        else:
            has = np.zeros(j - i, bool)
        doc = w.document()
        strange = np.flatnonzero(~plain & ~has[doc])
        odd_doc += doc[strange].tolist()
        odd += ["▁" * m + data[a:b].decode() for m, a, b in zip(marks[strange].tolist(), w.start[strange].tolist(), w.end[strange].tolist(), strict=True)]
        tail = own[1:].copy()  # blanks after the last word
        tail[w.count > 0] -= w.end[w.first[1:][w.count > 0] - 1]
        blank = (w.count == 0) & (own[1:] > own[:-1])
        tail[w.count == 0] = 0
        tail[blank] = (own[1:] - own[:-1])[blank] + 1
        for d in np.flatnonzero((tail > 0) & ~has).tolist():
            odd_doc.append(d)
            odd.append("▁" * int(tail[d]))
        use = np.flatnonzero(plain & ~has[doc])
        hashes, one, which = np.unique(w.hash[use], return_index=True, return_inverse=True)
        at = use[one]

        def spell(new: np.ndarray, at=at, w=w, data=data) -> list[str]:
            return ["▁" + data[a:b].decode() for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)]

        n = np.bincount(doc[use], weights=_known(v, file, hashes, spell)[which], minlength=j - i)
        if odd:
            each = {x: k for k, x in enumerate(dict.fromkeys(odd))}
            cost = v.count(list(each))
            n += np.bincount(odd_doc, weights=cost[[each[x] for x in odd]], minlength=j - i)
        out[i:j] = n.astype(np.int64)
    return out


def count_tokens(df: DataFrame, model: str = "piece_bpe_32k.model", keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 4096) -> DataFrame:
    """The columns keep, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    model is a file of public_tokenizers or a path. Null counts as an empty text, which has no tokens; every input row gives a
    row. A text is taken whole: nothing is cut off, padded or added, and strings that spell special tokens are ordinary text.
    """
    schema = extended(df.select(*keep), "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = model if "/" in model else model_path(model)
        for b in batches:
            texts = pc.fill_null(b.column(len(keep)), "")
            n = token_counts(texts, file)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
