"""Secrets: a character-level convolutional network over every candidate and its surroundings, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import blocks, byte_class, text_arrays
from fieldloom.llm._spark import extended, hash_share

#: The base kinds, by pattern: assignments (group 2 of 6 characters or more), access keys of 20 or more, hex runs of 24 or more.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: Spans that the network alone finds.
FOUND = "found"
#: Candidates of the network: runs of these characters, of so many.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Candidates that are words by their looks.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RUN_BYTES = byte_class(r"[A-Za-z0-9+/_.=-]")
#: Documents, about, from whose candidates the network learns as well, and candidates of each.
FIT_DOCS, FIT_EACH = 6000, 4
#: Characters seen before a candidate, of it and after it; of a longer candidate every stretch of INSIDE is seen and the best counts.
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
#: Score below which a first network's word is taken that an unlabelled candidate of the corpus is no secret.
HARMLESS = 0.05
#: Share of labelled findings above the threshold, on findings not learnt from.
RECALL = 0.97

_CODE = np.zeros(128, np.int64)
_CODE[32:127] = np.arange(1, 96)
_OTHER = 96


def _encoded(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character codes around each stretch of a candidate; 0 where there is no character, 97 to 191 inside the candidate."""
    out = []
    for a in range(start, end, INSIDE):
        b = min(a + INSIDE, end)
        row = np.zeros(LENGTH, np.int64)
        for at, part, inside in ((BEFORE - min(BEFORE, a), text[max(0, a - BEFORE) : a], 0), (BEFORE, text[a:b], 96), (BEFORE + INSIDE, text[b : b + AFTER], 0)):
            if part:
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                known = np.where(codes < 128, _CODE[np.minimum(codes, 127)], _OTHER)
                row[at : at + len(codes)] = known + np.where(known < _OTHER, inside, 0)
        out.append(row)
    return out


class SecretNetwork:
    """Character embeddings, filters of two widths, max-pooled over the window, and a logistic output."""

    WIDTHS, DIM, FILTERS = (3, 6), 10, 20

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.emb = (r.standard_normal((192, self.DIM)) * 0.3).astype(np.float32)
        self.taps = [(r.standard_normal((w * self.DIM, self.FILTERS)) / np.sqrt(w * self.DIM)).astype(np.float32) for w in self.WIDTHS]
        self.bias = np.zeros(len(self.WIDTHS) * self.FILTERS, np.float32)
        self.out = (r.standard_normal(len(self.WIDTHS) * self.FILTERS) * 0.2).astype(np.float32)
        self.off = np.float32(0)
        self.threshold = 0.5

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.emb[x]
        best, place = [], []
        for w, taps in zip(self.WIDTHS, self.taps, strict=True):
            windows = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - w + 1, w * self.DIM)
            c = windows @ taps
            at = c.argmax(1)
            best.append(np.take_along_axis(c, at[:, None, :], 1)[:, 0])
            place.append(at)
        return np.maximum(np.concatenate(best, 1) + self.bias, 0), np.concatenate(place, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i in range(0, len(x), 512):
            pooled, _ = self._pooled(x[i : i + 512])
            out[i : i + 512] = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.off, -30, 30)))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, rate: float = 0.03, seed: int = 5) -> SecretNetwork:
        """Trains on four fifths; on the rest, the threshold is the highest that keeps RECALL of the findings."""
        r = np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 4
        train = np.flatnonzero(~held)
        params = [self.emb, *self.taps, self.bias, self.out]
        seen = [np.full(p.shape, 1e-4, np.float32) for p in params]
        for _ in range(rounds):
            for batch in np.array_split(r.permutation(train), max(1, len(train) // 64)):
                own = x[batch]
                pooled, place = self._pooled(own)
                g = ((1 / (1 + np.exp(-np.clip(pooled @ self.out + self.off, -30, 30))) - y[batch]) / len(batch)).astype(np.float32)
                back = g[:, None] * self.out * (pooled > 0)
                grad = [np.zeros_like(p) for p in params]
                grad[-1] = g @ pooled
                grad[-2] = back.sum(0)
                for i, w in enumerate(self.WIDTHS):
                    cols = slice(i * self.FILTERS, (i + 1) * self.FILTERS)
                    at = place[:, cols][:, :, None] + np.arange(w)  # rows, filters, taps
                    chars = np.take_along_axis(own[:, None, :], at, 2)
                    e = self.emb[chars].reshape(len(batch), self.FILTERS, w * self.DIM)
                    grad[1 + i] = np.einsum("nf,nfd->df", back[:, cols], e)
                    step = (back[:, cols][:, :, None] * self.taps[i].T[None]).reshape(-1, self.DIM)
                    np.add.at(grad[0], chars.reshape(-1), step)
                for p, q, d in zip(params, seen, grad, strict=True):
                    q += d**2
                    p -= rate * d / np.sqrt(q)
                self.off -= np.float32(rate * g.sum())
        good = np.sort(self.scores(x[held & (y > 0)]))
        self.threshold = float(good[int((1 - RECALL) * len(good))])
        return self


def labelled_findings(n: int = 2400, seed: int = 17) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Findings made by rule, half of them secrets: text, start and end of the candidate, and the labels.

    Secrets are random keys in usual formats; the others are long words, names, numbers, dates, paths, versions and rulers.
    """
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(r.choice(list(s), k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ["an", "the", "ing", "er", "tion", "on", "sch", "ver", "keit", "que", "ment", "ou", "cion", "ado", "re", "st", "en", "ll"]
    word = lambda k: "".join(r.choice(syllables, k))
    prose = lambda k: " ".join(word(int(r.integers(1, 4))) for _ in range(k))
    secret = [
        lambda: pick("0123456789abcdef", int(r.choice([16, 20, 32, 40, 64]))), lambda: pick(lower + upper + digit, int(r.integers(18, 48))), lambda: pick(lower + upper + digit + "+/", int(r.integers(22, 64))) + "=" * int(r.integers(0, 3)),
        lambda: "AKIA" + pick(upper + digit, 16), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-"]) + pick(lower + upper + digit, int(r.integers(20, 40))), lambda: "eyJ" + pick(lower + upper + digit + "_-", 20) + "." + pick(lower + upper + digit + "_-", 24),
        lambda: pick(lower + digit, int(r.integers(18, 40))),
    ]
    other = [
        lambda: word(int(r.integers(6, 10))) + pick(digit, int(r.integers(1, 3))), lambda: "_".join(word(2) for _ in range(int(r.integers(3, 6)))) + "_" + pick(digit, 2), lambda: "-".join(word(2) for _ in range(int(r.integers(3, 6)))) + pick(digit, 1),
        lambda: "/".join([word(2), word(2), pick(digit, 4), word(2) + ".html"]), lambda: f"20{pick(digit, 2)}-{pick('01', 1)}{pick('012', 1)}-{pick('012', 1)}{pick(digit, 1)}T{pick('01', 1)}{pick(digit, 1)}.{pick('0123', 1)}{pick(digit, 1)}.00",
        lambda: pick(digit, int(r.integers(16, 22))), lambda: ".".join(pick(digit, int(r.integers(1, 4))) for _ in range(int(r.integers(6, 9)))), lambda: pick("-=._", 1) * int(r.integers(16, 40)) + pick(digit, 1),
        lambda: word(3) + "." + word(3) + "." + pick(digit, 2) + ".example.com", lambda: word(2) + "-v" + ".".join(pick(digit, 1) for _ in range(3)) + "-" + word(3) + ".tar.gz", lambda: word(4).upper() + "_" + word(4).upper() + pick(digit, 1),
        lambda: word(int(r.integers(6, 10))), lambda: word(int(r.integers(6, 10))).upper(), lambda: word(3).capitalize() + r.choice([".", "-", "/", "="]) + word(5), lambda: pick(lower + upper, 1) * int(r.integers(16, 60)),
    ]
    hint = ["key: ", "auth=", "Bearer ", "pwd = ", 'credential: "', "secret ", "x-api-key: ", "", "", ""]
    plain = ["see ", "file ", "version ", "page ", "http://www.", "id ", "", "", "", ""]
    out, labels = [], []
    for k in range(n):
        is_secret = k % 2
        kinds = secret if is_secret else other
        value = kinds[int(r.integers(len(kinds)))]()
        while len(value) < 16:
            value += word(2) if not is_secret else pick(digit + lower, 4)
        front = prose(int(r.integers(0, 6))) + " " + str(r.choice(hint if is_secret or r.random() < 0.15 else plain))
        out.append((front + value + str(r.choice(["", '"', " ", ".", ", "])) + prose(3), len(front), len(front) + len(value)))
        labels.append(is_secret)
    return out, np.array(labels)


def trained(seed: int = 3, corpus: list[tuple[str, int, int, int]] | None = None) -> SecretNetwork:
    """The network, trained on labelled_findings and on candidates of the corpus (text, start, end, label); the same at every run.

    Every second made-up finding stands between what surrounds a corpus candidate, so that surroundings tell as little as they do there;
    many of the harmless ones among them are words from those surroundings, run together.
    Corpus candidates of label 1 are secrets. The others are unlabelled, since a base pattern does not know every kind of secret: a first
    network learns without them, and only those that it finds clearly harmless (below HARMLESS), or that are letters of one case but
    for a capital in front, as words are, teach the second one as such.
    """
    rows, y = labelled_findings()
    if not corpus:
        return SecretNetwork(seed).fit(_windows(rows), y)
    r = np.random.default_rng(seed)
    pool = [w for t, a, b, _ in corpus for w in re.findall("[A-Za-z]{3,}", t[:a] + " " + t[b:])]
    for i in range(0, len(rows), 2):
        k = i + int(r.integers(2))
        t, a, b = rows[k]
        own, x, z, _ = corpus[int(r.integers(len(corpus)))]
        value = t[a:b]
        if not y[k] and pool and r.random() < 0.7:  # words of the corpus in one, as its own long words are
            value = pool[int(r.integers(len(pool)))]
            while len(value) < 16:
                value += pool[int(r.integers(len(pool)))].lower()
        rows[k] = (own[:x] + value + own[z:], x, x + len(value))
    seen, told = _windows([c[:3] for c in corpus]), np.array([c[3] for c in corpus])
    x, y = np.concatenate([_windows(rows), seen[told > 0]]), np.concatenate([y, np.ones((told > 0).sum(), int)])
    order = r.permutation(len(y))
    first = SecretNetwork(seed).fit(x[order], y[order])
    words = np.array([bool(WORD.fullmatch(t, a, b)) for t, a, b, _ in corpus])
    harmless = seen[(told == 0) & (words | (first.scores(seen) < HARMLESS))]
    x, y = np.concatenate([x, harmless]), np.concatenate([y, np.zeros(len(harmless), int)])
    order = r.permutation(len(y))
    return SecretNetwork(seed).fit(x[order], y[order])


def _windows(rows: list[tuple[str, int, int]]) -> np.ndarray:
    return np.stack([_encoded(t, a, min(b, a + INSIDE))[0] for t, a, b in rows]) if rows else np.zeros((0, LENGTH), np.int64)


def corpus_findings(df: DataFrame, text: str = "text") -> list[tuple[str, int, int, int]]:
    """Candidates, with their surroundings, of about FIT_DOCS texts chosen by hash, FIT_EACH of a text: 1 for one that a base span touches,
    0 for any other, which may be a secret or not. Repeated texts count once; the same rows at every run."""
    docs = df.select(F.col(text).alias("__text")).where("__text is not null")
    n = docs.count()
    some = docs.where(hash_share(F.col("__text"), FIT_DOCS / max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base = base_spans(t)
                for m, _ in zip(RUN.finditer(t), range(FIT_EACH), strict=False):
                    lo, hi = max(0, m.start() - BEFORE), min(m.end(), m.start() + INSIDE)
                    out.append((t[lo : hi + AFTER], m.start() - lo, hi - lo, int(any(x < m.end() and m.start() < z for x, z, _ in base))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["t", "a", "b", "y"])

    found = some.mapInArrow(run, "t string, a long, b long, y long").distinct().orderBy(F.xxhash64("t", "a"), "t", "a", "b").limit(2 * FIT_EACH * FIT_DOCS)
    return [tuple(r) for r in found.collect()]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans of a text: leftmost matches of each kind that do not overlap, failing ones dropped, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, BASE[k]) for a, k, b in sorted(out)]


def _worth_reading(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text may hold a span: a colon or equals sign, or a run of 16 candidate characters, which every access key and
    hex run has."""
    mark = np.concatenate([[0], np.cumsum((raw == 58) | (raw == 61))])
    inside = _RUN_BYTES[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    use = end - start >= 16
    out = mark[offsets[1:]] > mark[offsets[:-1]]
    # a run may reach over the end of a text into the next one
    for d in (np.searchsorted(offsets, start[use], "right") - 1, np.searchsorted(offsets, end[use] - 1, "right") - 1):
        out[d] = True
    over = np.flatnonzero(np.searchsorted(offsets, end[use] - 1, "right") - np.searchsorted(offsets, start[use], "right") > 1)
    for a, b in zip(start[use][over].tolist(), end[use][over].tolist(), strict=True):
        out[np.searchsorted(offsets, a, "right") - 1 : np.searchsorted(offsets, b - 1, "right")] = True
    return out


def find_secrets(column: pa.Array, network: SecretNetwork) -> list[list[dict]]:
    """The spans of each text: start, end (code points, exclusive), kind and the network's score, by start, then kind.

    Base spans stay whatever their score; the network adds candidates at or above its threshold that no base span touches.
    """
    buf, offsets = text_arrays(column)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for i, j in blocks(offsets, 1 << 20):
        raw, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        spans, rows, owner, done = [], [], [], 0
        for d in np.flatnonzero(_worth_reading(raw, own)).tolist():
            text = raw[own[d] : own[d + 1]].tobytes().decode()
            base = base_spans(text)
            end_so_far = 0
            reach = []
            for a, b, kind in base:
                spans.append((i + d, a, b, kind))
                reach.append((a, b))
            reach.sort()
            k = 0
            for m in RUN.finditer(text):
                a, b = m.span()
                while k < len(reach) and reach[k][0] < b:
                    end_so_far = max(end_so_far, reach[k][1])
                    k += 1
                if end_so_far <= a:
                    spans.append((i + d, a, b, FOUND))
            for s in range(done, len(spans)):
                own_rows = _encoded(text, spans[s][1], spans[s][2])
                rows += own_rows
                owner += [s] * len(own_rows)
            done = len(spans)
            if len(rows) >= 4096:
                _scored(spans, rows, owner, network, out)
                spans, rows, owner, done = [], [], [], 0
        _scored(spans, rows, owner, network, out)
    return out


def _scored(spans: list, rows: list, owner: list, network: SecretNetwork, out: list[list[dict]]) -> None:
    if not spans:
        return
    best = np.zeros(len(spans))
    np.maximum.at(best, owner, network.scores(np.stack(rows)))
    for (d, a, b, kind), score in zip(spans, best.tolist(), strict=True):
        if kind != FOUND or score >= network.threshold:
            out[d].append({"start": a, "end": b, "kind": kind, "score": score})
    order = {k: n for n, k in enumerate((*BASE, FOUND))}
    for d in {s[0] for s in spans}:
        out[d].sort(key=lambda s: (s["start"], order[s["kind"]]))


def scan_secrets(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep and secrets, an array of spans (start, end, kind, score) of each row's whole text.

    Null counts as an empty text, without spans; every input row gives a row, repeated rows included, and other columns are left
    out. An empty table gives an empty result. Spans that start together come in the order of their kinds.
    """
    network = df.sparkSession.sparkContext.broadcast(trained(corpus=corpus_findings(df, text)))
    schema = extended(df.select(*keep), "secrets array<struct<start:int,end:int,kind:string,score:double>>")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(find_secrets(b.column(len(keep)), network.value), kind)], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
