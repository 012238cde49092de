"""Chat formatting: successive prefixes of a conversation are rendered by a black box and compared, to find each turn's span."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm._spark import partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: A window that suits templates whose output for a turn depends on few turns before it.
WINDOW = 64
END = "<|end|>\n"
#: Texts that show where a template puts a turn's text.
PROBES = ("Q", "Z")
BAR = "\\b"


def escape(text: str) -> str:
    """A text that holds no `<`, with which every control string begins; reversible."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "|"}.get(m[1], m[1]), text, flags=re.S)


def default_template(turns: list[Turn]) -> str:
    """Each turn as <|role|>, a line break, the text, <|end|> and a line break, with role (its bars as well) and text escaped."""
    return "".join(f"<|{escape(role).replace('|', BAR)}|>\n{escape(text)}{END}" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str, int]]:
    """Role, text and the place of the escaped text of each turn that default_template has rendered."""
    out, at = [], 0
    while at < len(formatted):
        stop = formatted.index("<|end|>", at)
        head = formatted.index("|>\n", at)
        out.append((unescape(formatted[at + 2 : head]), unescape(formatted[head + 3 : stop]), head + 3))
        at = stop + len(END)
    return out


class RewritesHistory(ValueError):
    """A template whose output for a conversation does not begin with its output for the turns before the last."""


@dataclass
class Rendered:
    """The formatted conversation, the span that each turn added, and that of each learnt text within it."""

    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    loss: list[tuple[int, int] | None] = field(default_factory=list)
    #: Learnt turns whose text the template leaves out.
    omitted: int = 0
    #: Whether windows were asked for but all prefixes were rendered, as windows do not agree or the template failed on one.
    whole: bool = False


def _added(template: Template, context: list[Turn], before: str, turn: Turn) -> tuple[str, str]:
    """What rendering the context and one more turn adds to what the context gave, and the whole."""
    now = template([*context, turn])
    if not now.startswith(before):
        raise RewritesHistory("a turn changes what was rendered before it")
    return now[len(before) :], now


def render(turns: Iterable[Turn], template: Template = default_template, learn: tuple[str, ...] = ("assistant",), window: int | None = None) -> Rendered:
    """Renders each prefix and compares it with the one before: what it adds is the last turn's span.

    The template is a black box. RewritesHistory is raised where a prefix's output does not begin with the shorter one's. Of a
    learnt turn, rendering it with two one-letter texts shows the frame: all that both outputs have in common.
    A template that leaves a learnt text out gives both the same output: nothing of that turn is learnt, and `omitted` counts it.

    All prefixes are rendered, at a cost that grows with the square of the turns. A window says that the template is local, that what a turn
    adds depends on fewer than half so many turns before it: a conversation of over `window` turns then goes on with the latter half
    of them as context, at a cost that grows with the turns. The half must add the same as it did before, and the whole prefix is
    rendered whenever the turns have doubled and at the end; where that differs, or the template fails on a window, all prefixes are
    rendered after all and `whole` tells so. A template that is not local may still rewrite history between these checks unnoticed.
    """
    turns = list(turns)
    if window is None or len(turns) <= window:
        return _rendered(turns, template, learn, len(turns))
    try:
        return _rendered(turns, template, learn, window)
    except RewritesHistory:
        pass
    except Exception as e:  # the template's own: it may need the turns that a window leaves out; a real fault comes again below
        logging.getLogger(__name__).info("all prefixes are rendered, as the template failed on a window: %s", e)
    out = _rendered(turns, template, learn, len(turns))
    out.whole = True
    return out


def _common(one: str, two: str) -> int | None:
    """How many characters two outputs of one length share in front; None where they are equal."""
    if len(one) != len(two):
        raise RewritesHistory("the frame of a turn depends on its text")
    return next((k for k, (x, y) in enumerate(zip(one, two, strict=True)) if x != y), None)


def _rendered(turns: list[Turn], template: Template, learn: tuple[str, ...], window: int) -> Rendered:
    out, parts, at = Rendered(), [], 0
    context: list[Turn] = []
    before, history = template([]), []
    if before:
        parts.append(before)
        at = len(before)
    check = 2 * window
    for done, turn in enumerate(turns, 1):
        if len(context) >= window:
            half = context[-(window // 2) :]
            again, same = template([]), True
            for k, old in enumerate(half):
                added, again = _added(template, half[:k], again, old)
                same &= added == history[-len(half) + k]
            if not same:
                raise RewritesHistory("a window adds what the whole prefix does not")
            context, history, before = half, history[-len(half) :], again
        added, now = _added(template, context, before, turn)
        out.spans.append((at, at + len(added)))
        span = None
        if turn[0] in learn:
            one, two = (_added(template, context, before, (turn[0], probe))[0] for probe in PROBES)
            front = _common(one, two)
            if front is None:
                out.omitted += 1
            else:
                tail = _common(one[::-1], two[::-1])
                if len(added) < front + tail or added[:front] != one[:front] or tail and added[-tail:] != one[-tail:]:
                    raise RewritesHistory("the frame of a turn depends on its text")
                span = (at + front, at + len(added) - tail)
        out.loss.append(span)
        parts.append(added)
        at += len(added)
        context.append(turn)
        history.append(added)
        before = now
        if len(turns) > window and done in (check, len(turns)):
            check *= 2
            if "".join(parts) != template(turns[:done]):
                raise RewritesHistory("windows give what the whole prefix does not")
    out.text = "".join(parts)
    return out


def format_conversations(df: DataFrame, template: Template = default_template, learn: tuple[str, ...] = ("assistant",), window: int | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, spans and loss (arrays of start and end in code points, ends exclusive),
    rewrites, true where the template rewrites history (then without spans), omitted, the learnt turns whose text it leaves out, and whole,
    true where a window was given (see render) and all prefixes were rendered after all.

    Turns come by number (null first), then role, then text; a null role or text is empty, null ids are one conversation,
    repeated rows are turns of their own. An empty table gives no rows. Rows are dealt by conversation, sorted, and read in a
    stream that holds one conversation at a time.
    """
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites boolean, omitted int, whole boolean").fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[object, str, str]]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def packed(done: list) -> pa.RecordBatch:
            ids, results = zip(*done, strict=True)
            as_spans = lambda x: [{"start": a, "end": b} for a, b in x]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array([r.text for r, _ in results]), pa.array([as_spans(r.spans) for r, _ in results], span),
                pa.array([as_spans([x for x in r.loss if x]) for r, _ in results], span), pa.array([bad for _, bad in results]),
                pa.array([r.omitted for r, _ in results], pa.int32()), pa.array([r.whole for r, _ in results], pa.bool_()),
            ], names=["conv_id", "formatted", "spans", "loss", "rewrites", "omitted", "whole"])

        def finished(turns: list[Turn]) -> tuple[Rendered, bool]:
            try:
                return render(turns, template, learn, window), False
            except RewritesHistory:
                return Rendered(template(turns)), True

        kind, done, held, now, turns = None, [], 0, None, []
        for key, r, t in stream():
            if turns and key != now:
                done.append((now, finished(turns)))
                held += len(done[-1][1][0].text)
                turns = []
                if held > 1 << 22 or len(done) >= 4096:
                    yield packed(done)
                    done, held = [], 0
            now = key
            turns.append((r, t))
        if turns:
            done.append((now, finished(turns)))
        if done:
            yield packed(done)

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and learnt (array of the texts under the loss mask, unescaped), read from what
    default_template gave, with formatted_chars."""
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL("turns array<struct<role:string,text:string>>, learnt array<string>, formatted_chars long").fields])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            turns = [[{"role": r, "text": x} for r, x, _ in read_turns(t)] for t in texts]
            learnt = [[unescape(t[s["start"] : s["end"]]) for s in loss] for t, loss in zip(texts, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, kind), pa.array(learnt, pa.list_(pa.string())), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def turns_digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
