"""Quality: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import LOWER, NOT_SPACE, Words, blocks, byte_class, mix, text_arrays
from fieldloom.llm._spark import extended, free_name, hash_share
from fieldloom.llm.decontamination import Lookup
from fieldloom.llm.toxicity import FUNCTION_WORDS

#: Rows used to fit the scorer, about, and the bytes of the longest text among them.
FIT_ROWS, FIT_BYTES = 6000, 40_000
SLOTS = 1 << 16
#: Votes of a labeller.
ABSTAIN, GOOD, BAD = 0, 1, 2
_UPPER = byte_class("[A-Z]")
_ALPHA = byte_class(r"[A-Za-z\x80-\xff]")
_WORDISH = byte_class(r"[A-Za-z0-9\x80-\xff]")
_SHAPE = LOWER.copy()
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97

_BARS = np.isin(np.arange(256), list(b"|<>\\"))
#: Figures of which little is bad.
_LOW = ("function",)

#: Labeller, the figure it reads, from where it votes bad, up to where good, and the words below which it abstains.
LABELLERS = (
    ("repeated words", "same_as_before", 0.15, 0.03, 5),
    ("capital letters", "upper", 0.40, 0.15, 3),
    ("symbols", "symbols", 0.14, 0.07, 3),
    ("words again", "again", 0.70, 0.45, 20),
    ("separators between words", "bare", 0.12, 0.01, 5),
    ("odd word ends", "odd_end", 0.40, 0.10, 3),
    ("repeated word pairs", "pair_again", 0.60, 0.15, 20),
    ("bars and arrows", "bars", 0.15, 0.01, 5),
    ("function words", "function", 0.02, 0.08, 15),
)


def _function_words() -> Lookup:
    buf, offsets = text_arrays(pa.array([" ".join(FUNCTION_WORDS.values())]))
    return Lookup.of(Words(buf, offsets, NOT_SPACE).hash)


_FUNCTION = _function_words()


def figures(w: Words, raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of each document, shares between 0 and 1 (zero without words)."""
    n = np.maximum(w.count, 1)
    doc = w.document()

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flag], minlength=len(n)) / n

    def in_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    same = np.zeros(len(w), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    letters, solid = np.maximum(in_bytes(_ALPHA), 1), np.maximum(in_bytes(NOT_SPACE), 1)
    last = raw[w.end - 1] if len(w) else raw[:0]
    before = raw[np.maximum(w.end - 2, 0)] if len(w) else raw[:0]
    long_ = w.end - w.start > 1
    word_total = np.concatenate([[0], np.cumsum(_WORDISH[raw])])
    pair = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w) > 1 else w.hash[:0]
    within = doc[1:] == doc[:-1]

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Distinct keys of each document."""
        order = np.argsort(mix(keys + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        k, d = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=len(n))

    pairs = np.bincount(doc[1:][within], minlength=len(n)) if len(w) > 1 else np.zeros(len(n))
    function = np.zeros(len(w), bool)
    function[_FUNCTION.find(w.hash)[0]] = True
    return {
        "function": share(function),
        "bars": in_bytes(_BARS) / n,
        "same_as_before": share(same),
        "upper": in_bytes(_UPPER) / letters,
        "symbols": 1 - in_bytes(_WORDISH) / solid,
        "again": 1 - distinct(w.hash, doc) / n,
        "bare": share(word_total[w.end] == word_total[w.start]) if len(w) else np.zeros(len(n)),
        "odd_end": share(long_ & ~_WORDISH[last] & (~_WORDISH[before])),
        "pair_again": 1 - np.where(pairs > 0, distinct(pair[within], doc[1:][within]) / np.maximum(pairs, 1), 1) if len(w) > 1 else np.zeros(len(n)),
    }


def votes(w: Words, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The votes of all labellers on each document."""
    f = figures(w, raw, offsets)
    out = np.zeros((len(w.count), len(LABELLERS)), np.int8)
    for k, (_, name, bad, good, least) in enumerate(LABELLERS):
        x = f[name]
        if name in _LOW:
            out[:, k] = np.where(x <= bad, BAD, np.where(x >= good, GOOD, ABSTAIN))
        else:
            out[:, k] = np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
        out[w.count < least, k] = ABSTAIN
    return out


def as_pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1], dtype=np.int64)


def from_pattern(p: np.ndarray) -> np.ndarray:
    return (np.asarray(p)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


class LabelModel:
    """Accuracies of labellers that vote independently given the class, by expectation-maximisation over vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        v, n = from_pattern(patterns), counts.astype(np.float64)
        k = v.shape[1]
        self.prior = 0.1  # of the class bad
        # theta[class, labeller, vote]: a vote for bad starts as precise, one for good as weak, since each looks for one defect only
        self.theta = np.tile(np.array([[0.2, 0.79, 0.01], [0.3, 0.4, 0.3]])[:, None, :], (1, k, 1))
        for _ in range(rounds if n.sum() else 0):
            post = self.posterior(patterns)
            for c, weight in enumerate((n * (1 - post), n * post)):
                for vote in range(3):
                    self.theta[c, :, vote] = ((v == vote) * weight[:, None]).sum(0) + 0.5
                self.theta[c] /= self.theta[c].sum(1, keepdims=True)
            self.prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 0.5))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of the class bad for each pattern; abstaining says nothing."""
        v = from_pattern(patterns)
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k in range(v.shape[1]):
            voted = v[:, k] != ABSTAIN
            say = self.theta[:, k, 1:] / self.theta[:, k, 1:].sum(1, keepdims=True)
            z[voted] += np.log(say[1, v[voted, k] - 1] / say[0, v[voted, k] - 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller that votes is right, on average over the two classes."""
        say = self.theta[:, :, 1:] / self.theta[:, :, 1:].sum(2, keepdims=True)
        return {name: float((say[0, k, 0] + say[1, k, 1]) / 2) for k, (name, *_) in enumerate(LABELLERS)}


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Slots of each word's four features: its letters, its shape, its last two bytes, and its likeness to the two before."""
    w = Words(buf, offsets, NOT_SPACE, LOWER)
    shape = Words(buf, offsets, NOT_SPACE, _SHAPE).hash
    doc = w.document()
    like = np.zeros(len(w), np.uint64)
    for k in (1, 2):
        like[k:] += np.uint64(k) * ((w.hash[k:] == w.hash[:-k]) & (doc[k:] == doc[:-k]))
    last = buf[w.end - 1].astype(np.uint64) if len(w) else np.zeros(0, np.uint64)
    before = np.where(w.end - w.start > 1, _SHAPE[buf[np.maximum(w.end - 2, 0)]] if len(w) else 0, 0).astype(np.uint64)
    ends = np.where(_WORDISH[last.astype(np.int64)], np.uint64(1), last) * np.uint64(256) + before
    kinds = (w.hash, shape, ends, like)
    return w, np.stack([(mix(h * np.uint64(4) + np.uint64(k)) & np.uint64(SLOTS - 1)).astype(np.int32) for k, h in enumerate(kinds)], axis=1)


class LinearScorer:
    """Logistic regression on the mean of hashed word features."""

    def __init__(self) -> None:
        self.weight, self.off = np.zeros(SLOTS, np.float64), 0.0

    def fit(self, column: pa.Array, bad: np.ndarray, rounds: int = 150, rate: float = 1.0) -> LinearScorer:
        """Full-batch training on texts and the probability that each is bad, both classes weighing alike."""
        if not len(bad):
            return self
        buf, offsets = text_arrays(column)
        parts = []
        for i, j in blocks(offsets, 1 << 19):  # little memory: the driver counts each block's features at once
            w, slots = _features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(i, j), w.count)
            key, n = np.unique((doc[:, None] * SLOTS + slots).ravel(), return_counts=True)
            parts.append(((key // SLOTS).astype(np.int32), (key % SLOTS).astype(np.int32), (n / np.maximum(w.count, 1)[key // SLOTS - i]).astype(np.float32)))
        row, col, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        cost = np.where(bad > 0.5, 0.5 / max(1e-6, (bad > 0.5).mean()), 0.5 / max(1e-6, (bad <= 0.5).mean())) / len(bad)
        seen, off_seen = np.full(SLOTS, 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(row, weights=x * self.weight[col], minlength=len(bad)) + self.off
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) * cost
            grad = np.bincount(col, weights=x * g[row], minlength=SLOTS) + 1e-6 * self.weight
            seen += grad**2
            self.weight -= rate * grad / np.sqrt(seen)
            off_seen += g.sum() ** 2
            self.off -= rate * g.sum() / np.sqrt(off_seen)
        return self

    def bad(self, column: pa.Array) -> np.ndarray:
        """The probability that each text is bad."""
        buf, offsets = text_arrays(column)
        out = np.zeros(len(column))
        for i, j in blocks(offsets, 1 << 20):
            w, slots = _features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total = np.concatenate([[0.0], np.cumsum(self.weight[slots].sum(1))])
            z = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(w.count, 1) + self.off
            out[i:j] = np.where(w.count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1.0)
        return out


def _patterns(column: pa.Array) -> np.ndarray:
    buf, offsets = text_arrays(column)
    out = np.zeros(len(column), np.int64)
    for i, j in blocks(offsets, 1 << 20):
        raw, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        out[i:j] = as_pattern(votes(Words(raw, own, NOT_SPACE), raw, own))
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[LabelModel, LinearScorer]:
    """The label model from the votes on all documents, and a scorer fitted on about FIT_ROWS of them, chosen by hash, with
    the model's posteriors as labels; rows over FIT_BYTES bytes are not learnt from, repeated rows once."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = np.unique(_patterns(b.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])

    # one row for each pattern: 3 to the number of labellers at most
    seen = docs.select(F.col(text).alias("__text")).mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = LabelModel(np.array([r["pattern"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.int64))
    total = sum(r["n"] for r in seen)
    some = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(fit_share(F.col("__id"), F.col("__text"), FIT_ROWS / max(1, total)) & (F.octet_length("__text") <= FIT_BYTES))
    # rows that are alike enter together, and count once; the limit is far above what the share gives
    some = some.dropDuplicates().orderBy(F.xxhash64("__id", "__text"), "__id", "__text").limit(2 * FIT_ROWS)
    rows = some.toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])
    texts = rows.column("__text").combine_chunks()
    return model, LinearScorer().fit(texts, model.posterior(_patterns(texts)))


def fit_share(ident: Column, text: Column, share: float) -> Column:
    """Whether a row is learnt from, by a hash of id and text: rows of one id, or without, do not enter together."""
    return hash_share(F.xxhash64(F.coalesce(ident.cast("string"), F.lit("")), text), share)


def score_quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The columns keep, quality (0 to 1), label_quality (the label model's posterior) and kept (quality >= least).

    A text without words, or null, has quality 0. Every input row gives a row, with equal texts scored alike; null ids are no special
    case; an empty table gives an empty result.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text))
    schema = extended(docs.select(*keep), "quality double, label_quality double, kept boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, scorer = models.value
        for b in batches:
            column = b.column(len(keep))
            good = 1 - scorer.bad(column)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(good), pa.array(1 - label.posterior(_patterns(column))), pa.array(good >= least)], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose quality is at least `least`."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, scorer = models.value
        for b in batches:
            kept = b.filter(pa.array(1 - scorer.bad(b.column(b.num_columns - 1)) >= least))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return docs.select("*", F.col(text).alias(free_name(docs, "__text"))).mapInArrow(run, docs.schema)
