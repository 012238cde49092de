"""Names of a dictionary found in texts: one automaton over all names reads each text once, or, for any number of names, a join on words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names, and their characters together, of which one automaton is made and sent to all executors.
MOST_NAMES, MOST_CHARS = 200_000, 8_000_000
_END = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _known(names: DataFrame, name: str) -> DataFrame:
    """name and its lower-case form, of names that are neither null nor blank, each once."""
    return names.select(F.col(name)).where(F.trim(F.col(name)) != "").distinct().withColumn("__n", F.lower(F.col(name)))


def _automaton(forms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for f in forms:
        out.add_word(f, len(f))
    out.make_automaton()
    return out


def _bounded(known: DataFrame, most: int) -> Broadcast | None:
    """The distinct forms of known names on all executors; None if there are over `most`, or over MOST_CHARS characters of them."""
    forms = known.select("__n").distinct()
    size = forms.agg(F.count("*").alias("n"), F.sum(F.length("__n")).alias("chars")).first()
    if size["n"] > most or (size["chars"] or 0) > MOST_CHARS:
        return None
    return known.sparkSession.sparkContext.broadcast([r[0] for r in forms.collect()])


def _words_apart(text: str, start: int, end: int) -> bool:
    """Whether a match neither begins nor ends within a word."""
    first = start == 0 or not (text[start].isalnum() and text[start - 1].isalnum())
    return first and (end == len(text) or not (text[end - 1].isalnum() and text[end].isalnum()))


def spans(texts: DataFrame, names: DataFrame, doc: str, text: str, name: str, whole_words: bool = True, most: int = MOST_NAMES) -> DataFrame:
    """doc, start, end (characters of the text in lower case, end exclusive) and form, the name in lower case, of every occurrence of every
    name, overlapping ones included; with whole_words none that begins or ends within a word.

    Time is linear in the text and what is found, whatever the number of names. The dictionary is bounded: over `most` names or MOST_CHARS
    characters are refused (sentence_mentions takes any number). Null texts and blank names give nothing, repeated names and rows
    count as they come; a null doc stays null.
    """
    forms = _bounded(_known(names, name), most)
    if forms is None:
        raise ValueError("there are more names than one automaton takes")
    rows = texts.select(doc, F.lower(F.col(text)).alias("__text"))
    schema = StructType([rows.schema[doc], *StructType.fromDDL("start int, end int, form string").fields])
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built and forms.value:
            built.append(_automaton(forms.value))
        for b in batches if forms.value else ():
            for k in range(0, len(b), 256):
                part, at, start, end, form = b.slice(k, 256), [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for last, n in built[0].iter(t) if t else ():
                        a, z = last + 1 - n, last + 1
                        if not whole_words or _words_apart(t, a, z):
                            at.append(i)
                            start.append(a)
                            end.append(z)
                            form.append(t[a:z])
                keys = part.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(form, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def sentence_mentions(texts: DataFrame, names: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """doc, sentence (its place) and name where a sentence contains a name of one or more words, whatever the case, each once.

    Sentences end at [.!?] before white space; names begin at a word's start and hold a letter or digit of a-z, 0-9. Up to MOST_NAMES names,
    one automaton reads each text once where it lies, and only what it finds is shuffled. With more of them, the words of sentences meet
    the first words of names without the sentences' text, and only sentences in which a first word was met are read again. Null texts
    and names give nothing; repeated docs are taken for one another's sentences.
    """
    own = _known(names, name).where(F.col("__n").rlike("[a-z0-9]"))
    forms = _bounded(own, MOST_NAMES)
    if forms is None:
        return _by_words(texts, own, doc, text, name)
    rows = texts.select(doc, F.lower(F.col(text)).alias("__text"))
    schema = StructType([rows.schema[doc], *StructType.fromDDL("sentence int, __n string").fields])
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built and forms.value:
            built.append(_automaton(forms.value))
        for b in batches if forms.value else ():
            at, place, form = [], [], []
            for i, t in enumerate(b.column(1)):
                for k, s in enumerate(_END.split(t.as_py() or "")):
                    met = {s[last + 1 - n : last + 1] for last, n in built[0].iter(s) if _begins(s, last + 1 - n, n)}
                    at += [i] * len(met)
                    place += [k] * len(met)
                    form += met
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(form, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).distinct().join(F.broadcast(own), "__n").select(doc, "sentence", name)  # bounded by the check above


def _begins(text: str, start: int, size: int) -> bool:
    """Whether the first letter or digit of a name found at start begins a word there."""
    first = next(k for k in range(start, start + size) if text[k] in _PLAIN)
    return first == 0 or text[first - 1] not in _PLAIN


def _by_words(texts: DataFrame, own: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """What sentence_mentions gives, by joins, for any number of names (name, __n)."""

    def sentences() -> DataFrame:
        return texts.select(doc, F.posexplode(F.split(F.lower(F.col(text)), _END.pattern)).alias("sentence", "__s"))

    own = own.withColumn("__w", F.regexp_extract("__n", "[a-z0-9]+", 0))
    words = sentences().select(doc, "sentence", F.explode(F.array_distinct(F.regexp_extract_all("__s", F.lit("[a-z0-9]+"), F.lit(0)))).alias("__w"))
    met = words.join(own, "__w").select(F.col(doc).alias("__d"), F.col("sentence").alias("__k"), name, "__n", "__w").distinct()
    single = ~F.col("__n").rlike("[^a-z0-9]")  # the word itself is the name
    alone = met.where(single).select(F.col("__d").alias(doc), F.col("__k").alias("sentence"), name)
    read = sentences().join(met.where(~single), F.col(doc).eqNullSafe(F.col("__d")) & (F.col("sentence") == F.col("__k")))
    signs = F.regexp_extract("__n", "^[^a-z0-9]*", 0)
    begins = F.concat(F.lit(r"\Q"), signs, F.lit(r"\E(?<![a-z0-9])\Q"), F.substring("__n", F.length(signs) + 1, F.length("__n")), F.lit(r"\E"))
    return alone.unionByName(read.where(F.contains("__s", "__n")).where(F.regexp_like("__s", begins)).select(doc, "sentence", name)).distinct()
