"""Toxicity: a convolutional text classifier over hashed word embeddings, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._arrays import LOWER, Words, blocks, byte_class, mix, text_arrays
from fieldloom.llm._spark import extended, hash_share

#: Letters of ASCII and every byte of a character beyond it.
LETTERS = byte_class(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Labelled rows of each class used to fit, about, and the bytes of the longest text among them.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1200, 1800, 20_000
SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
PREFIXES = (3, 5)
#: Frequent function words (fixed values), by which a text's language is told from the text alone.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with on be it are this",
    "de": "der die und das nicht ein eine von mit zu den ist im dem sich auf",
    "fr": "le la les des et une dans que pour est du sur qui un au",
    "es": "el los las y una por con para del se lo como al su más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


class ToxicityModel:
    """Embeddings of a word and its prefixes, convolved with filters of several widths, max-pooled and combined linearly.

    A score is a logistic function of the distance to a threshold that is calibrated for each language told from the text.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = (r.standard_normal((SLOTS, DIM)) * 0.1).astype(np.float32)
        self.taps = [(r.standard_normal((w, DIM, FILTERS)) * (1.0 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (r.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.off = np.float32(0)
        self.threshold = np.zeros(len(LANGUAGES))
        self.sharp = 1.0
        self.langs = np.zeros((SLOTS, len(FUNCTION_WORDS)), np.float32)
        for k, words in enumerate(FUNCTION_WORDS.values()):
            buf, off = text_arrays(pa.array([words]))
            self.langs[self._slots(Words(buf, off, LETTERS, LOWER, PREFIXES))[:, 0], k] = 1

    @staticmethod
    def _slots(w: Words) -> np.ndarray:
        kinds = [w.hash, *w.prefix]
        return np.stack([(mix(h + np.uint64(k + 1)) & np.uint64(SLOTS - 1)).astype(np.int32) for k, h in enumerate(kinds)], axis=1)

    def _pooled(self, slots: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each document, 0 at least, and where it is."""
        n = np.diff(first)
        some = np.flatnonzero(n)
        out = np.zeros((len(n), len(WIDTHS) * FILTERS), np.float32)
        where = np.full(out.shape, -1, np.int64) if places else None
        if not len(some):
            return out, where
        e = self.emb[slots[:, 0]]
        for k in range(1, slots.shape[1]):
            e += self.emb[slots[:, k]]
        left = np.repeat(first[1:], n) - np.arange(len(slots))  # words up to the document's end
        for i, (w, taps) in enumerate(zip(WIDTHS, self.taps, strict=True)):
            c = e @ taps[0]
            for k in range(1, w):
                c[:-k] += (e @ taps[k])[k:]
            c += self.bias[i * FILTERS : (i + 1) * FILTERS]
            c[left < w] = 0
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best = np.maximum.reduceat(c, first[some], axis=0)
            out[some, cols] = np.maximum(best, 0)
            if places:
                for d, b in zip(some.tolist(), best, strict=True):
                    own = c[first[d] : first[d + 1]].argmax(0)
                    where[d, cols] = np.where(b > 0, own + first[d], -1)
        return out, where

    def fit(self, column: pa.Array, toxic: np.ndarray, steps: int = 240, rate: float = 0.05, seed: int = 11) -> ToxicityModel:
        """Trains on texts and labels; a fifth of them, every fifth in the order given, calibrates the thresholds.

        A twentieth as many empty texts are added as not toxic. Small sets are gone through more often, for about as many steps.
        """
        r = np.random.default_rng(seed)
        buf, offsets = text_arrays(column)
        extra = len(toxic) // 20
        offsets, toxic = np.concatenate([offsets, np.full(extra, offsets[-1])]), np.concatenate([toxic, np.zeros(extra, toxic.dtype)])
        w = Words(buf, offsets, LETTERS, LOWER, PREFIXES)
        slots, y = self._slots(w), toxic.astype(np.float32)
        if not 0 < y.sum() < len(y):
            self.off = np.float32(5.0 if len(y) and y.all() else -5.0)
            self.out[:] = 0
            return self
        held = np.arange(len(y)) % 5 == 4
        train = np.flatnonzero(~held)
        weight = np.where(y > 0, 0.5 / max(1e-6, y[train].mean()), 0.5 / max(1e-6, 1 - y[train].mean())).astype(np.float32)
        params = [self.emb, *self.taps, self.bias, self.out]
        seen = [np.full(p.shape, 1e-6, np.float32) for p in params]
        off_seen = 1e-6
        for _ in range(int(np.clip(steps * 48 // len(train), 4, 30))):
            for batch in np.array_split(r.permutation(train), max(1, len(train) // 48)):
                rows = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in batch])
                first = np.concatenate([[0], np.cumsum(w.count[batch])])
                own = slots[rows]
                pooled, where = self._pooled(own, first, places=True)
                z = pooled @ self.out + self.off
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                grad = [np.zeros_like(p) for p in params[1:]]
                touched, delta = [], []
                grad[-1] += g @ pooled
                back = g[:, None] * self.out
                d, f = np.nonzero(where >= 0)
                at, b = where[d, f], back[d, f]
                np.add.at(grad[-2], f, b)
                for i, width in enumerate(WIDTHS):
                    mine = f // FILTERS == i
                    for k in range(width):
                        pos, col, gb = at[mine] + k, f[mine] % FILTERS, b[mine]
                        s = own[pos]
                        e = self.emb[s].sum(1)
                        np.add.at(grad[i].transpose(0, 2, 1), (np.full(len(col), k), col), gb[:, None] * e)
                        step = gb[:, None] * self.taps[i][k].T[col]
                        for c in range(s.shape[1]):
                            touched.append(s[:, c])
                            delta.append(step)
                if touched:
                    slot, inv = np.unique(np.concatenate(touched), return_inverse=True)
                    total = np.zeros((len(slot), DIM), np.float32)
                    np.add.at(total, inv, np.concatenate(delta))
                    seen[0][slot] += total**2
                    self.emb[slot] -= rate * total / np.sqrt(seen[0][slot])
                for p, q, x in zip(params[1:], seen[1:], grad, strict=True):
                    q += x**2
                    p -= rate * x / np.sqrt(q)
                off_seen += float(g.sum()) ** 2
                self.off -= np.float32(rate * g.sum() / np.sqrt(off_seen))
        z, lang = self._logits(slots, w.first)
        self._calibrate(z[held], lang[held], y[held] > 0)
        return self

    def _calibrate(self, z: np.ndarray, lang: np.ndarray, toxic: np.ndarray) -> None:
        """For each language the cut of best F1, half way to the next value; all rows where a language has under ten of either class."""
        whole = _best_cut(z, toxic)
        for k in range(len(LANGUAGES)):
            own = lang == k
            enough = min(toxic[own].sum(), (~toxic[own]).sum()) >= 10
            self.threshold[k] = _best_cut(z[own], toxic[own]) if enough else whole
        self.sharp = 1.0

    def _logits(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(first)
        pooled, _ = self._pooled(slots, first)
        lang = np.full(len(n), len(LANGUAGES) - 1)
        some = np.flatnonzero(n)
        if len(some):
            votes = np.add.reduceat(self.langs[slots[:, 0]], first[some], axis=0)
            lang[some] = np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES) - 1)
        return (pooled @ self.out + self.off).astype(np.float64), lang

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text, 0 to 1; 0.5 is its language's threshold. Null counts as empty."""
        buf, offsets = text_arrays(column)
        out = np.zeros(len(column))
        for i, j in blocks(offsets, 1 << 20):
            w = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS, LOWER, PREFIXES)
            z, lang = self._logits(self._slots(w), w.first)
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.sharp * (z - self.threshold[lang]), -30, 30)))
        return out


def _best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    if not len(z) or not 0 < toxic.sum() < len(z):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + toxic.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1e-6)


def held_out(doc_id: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model fitted on about FIT_TOXIC and FIT_CLEAN labelled rows that are not held out, chosen by hash; rows without a
    label, id or text, or with one over FIT_BYTES bytes, are not learnt from, nor is an id that labels contradict. Equal labels and
    rows count once. The same rows are chosen at every run."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__toxic")).where(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.min("__toxic").alias("__toxic"), F.max("__toxic").alias("__most")).where("__toxic = __most").select("__id", "__toxic")
    n = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    share = F.when(F.col("__toxic") == 1, hash_share(F.col("__id"), FIT_TOXIC / max(1, n.get(1, 0)))).otherwise(hash_share(F.col("__id"), FIT_CLEAN / max(1, n.get(0, 0))))
    most, order = 2 * (FIT_TOXIC + FIT_CLEAN), F.xxhash64("__id")
    chosen = known.where(share).orderBy(order, "__id").limit(most)
    some = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(F.octet_length("__text") <= FIT_BYTES)
    rows = some.join(F.broadcast(chosen), "__id").select("__id", "__toxic", "__text").dropDuplicates()
    rows = rows.orderBy(F.xxhash64("__id", "__text"), "__id", "__text").limit(most).toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])
    return ToxicityModel().fit(rows.column("__text").combine_chunks(), rows.column("__toxic").to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The columns keep, held_out, score (0 to 1, at least 0.5: toxic) and predicted (0 or 1) of each row, from its whole text.

    Labels, and any column but the text, only fit the model. Null and empty texts get the score of a text without words;
    without labels of both classes every score is the same. Every input row gives a row, equal texts get equal scores; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))
    schema = extended(docs.select(*keep).withColumn("held_out", F.lit(True)), "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.scores(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*keep, held_out(doc_id).alias("held_out"), F.col(text).alias("__text")).mapInArrow(run, schema)
