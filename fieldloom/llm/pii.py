"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm them, nearby words adjust scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._spark import free_name

#: Stands for a separator inside a number or host name while patterns run, so that they need no nested repetition; the same
#: character in a text becomes the other one, which no pattern takes.
MARK, OTHER = "\x01", "\x02"
#: Code points before a span in which context words count.
NEAR = 40


@dataclass(frozen=True)
class Kind:
    """A kind of span: a cheap test of whole texts, the prepared text, the pattern, the check of a value, the score without and
    with a context word nearby, and the words."""

    name: str
    maybe: Callable[[Column], Column]
    prepare: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    near_score: float
    words: str


def _plain(text: Column) -> Column:
    return text


def _marked(before: str, what: str, after: str) -> Callable[[Column], Column]:
    """The text with MARK for each character `what` between the two classes; its length stays."""
    return lambda text: F.regexp_replace(F.translate(text, MARK, OTHER), f"(?<={before}){what}(?={after})", MARK)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the right check digit: from the right, every second one counts double, less 9 above 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number gives 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    chars = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


_LOCAL, _HOST = r"[A-Za-z0-9._%+\x01-]", "[A-Za-z0-9-]"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds of the contract's base first. Possessive repetition and the assertions in front keep every pattern linear in the text.
KINDS = (
    Kind("email", lambda t: t.contains("@"), _marked(_HOST, r"\.", _HOST), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++\x01[A-Za-z0-9\x01-]++", lambda v: F.lit(True), 0.9, 1.0, "mail|contact|kontakt|courriel|correo"),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), _plain, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{_BYTE}(\.{_BYTE})(\.{_BYTE})(\.{_BYTE})$"), 0.7, 0.9, "ip|host|server|address|adresse"),
    Kind("card", lambda t: t.rlike("[0-9](?:[ -]?[0-9]){13}"), _marked("[0-9]", "[ -]", "[0-9]"), r"[0-9\x01]{14,}", lambda v: F.length(_digits(v)).between(14, 19) & luhn(_digits(v)), 0.8, 1.0, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", lambda t: t.rlike(r"\+[0-9]"), _plain, r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), 0.7, 0.95, "phone|call|tel|mobile|fax"),
    Kind("iban", lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), _plain, "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", mod97, 0.8, 1.0, "iban|account|konto|compte|cuenta"),
    Kind("ssn", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _plain, "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: F.lit(True), 0.3, 0.8, "ssn|social security"),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """All valid spans of one kind: the values a pattern finds, placed by the lengths of what lies between them."""
    source = kind.prepare(text)
    values = F.regexp_extract_all(source, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(source, kind.pattern, -1)
    parts = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g"), F.length(v).alias("n")))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        one = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.when(kind.valid(x["v"]), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    found = F.aggregate(parts, zero, add, lambda a: a["out"])

    def scored(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] - NEAR + 1), F.least(F.lit(NEAR), x["start"])))
        score = F.when(before.rlike(kind.words), kind.near_score).otherwise(kind.score)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    return F.when(kind.maybe(text), F.transform(found, scored)).otherwise(F.array().cast(SPAN))


def with_pii(df: DataFrame, text: str = "text", column: str = "pii", least: float = 0.5) -> DataFrame:
    """df and an array of spans (start, rank, end, kind, score) with a score of at least `least`, by start, then kind.

    Starts and ends count code points, ends exclusive. Null counts as an empty text, without spans; every row stays as it is, repeated
    rows included; an empty table gives an empty result. A column of df that is named like `column` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(value, kind, rank) for rank, kind in enumerate(KINDS)])
    any_ = F.lit(False)
    for kind in KINDS:
        any_ = any_ | kind.maybe(value)
    kept = F.array_sort(F.filter(found, lambda x: x["score"] >= least))
    return df.withColumn(column, F.when(any_, kept).otherwise(F.array().cast(SPAN)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def listed(spans: Column, kinds: tuple[str, ...] = ()) -> Column:
    """kind:start:end of the spans (of the given kinds), comma-joined."""
    own = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""

    def add(a: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, zero, add, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_pii(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """df, with all its columns and rows, with personal data in `text` masked; a null text stays null."""
    name = free_name(df, "__pii")
    found = with_pii(df, text, name, least)
    return found.withColumn(text, masked(F.col(text), F.col(name))).select(*df.columns)
