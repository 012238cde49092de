"""Conversation structure repair: the cheapest edits that give turns a grammar, found backwards by cost and walked forwards.

The grammar is that of role initials, `(s?(ua)+)?`. A state tells what a conversation has so far: nothing, a system turn, or turns that end
with a user's or an assistant's. Costs to go are min-plus products over the states, so a conversation is cut into blocks of turn
numbers: each block gives its product at once, short streams chain the products of a conversation backwards and the states
forwards, and all that reads turns runs on single blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm._spark import dropped, partitions, written

#: Turn numbers of one block.
BLOCK = 256
#: Costs of keeping, rewriting the role, deleting and inserting a turn, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, a system turn, a user's turn last, an assistant's last; where a turn of user or assistant leads, and whose it is.
START, SYSTEM, USER, ASSISTANT = range(4)
ONWARD, WHOSE = (USER, USER, ASSISTANT, USER), (1, 1, 2, 1)
#: What may end, and the cost to go there with the turns inserted that are missing.
AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
TAIL = ("", "ua", "a", "")
#: Codes of a turn: its role's initial (s, u, a, any other), and its first fault four times as high.
BLANK, DUPLICATE, CUT = 1, 2, 3
_FAR = np.int64(1) << 40
_SPACES = " \t\n\x0b\f\r"
_KEYS = ("conv_id", "block")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by rule: of the checksum of `conv_id:turn` modulo 20, 0 drops the turn, 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Null is one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("rule")).where("rule <> 0")
    rule = F.col("rule")
    text = F.when(rule == 1, "").when(rule == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(rule == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(rule == 3, 2).otherwise(1)).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time")


def _coded(df: DataFrame) -> DataFrame:
    """Turns with their block, place in it, copies n of the same number, role and text, and code; equal rows are folded before any shuffle."""
    rows = df.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1)
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy(*_KEYS).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = F.when(end == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select(
        *_KEYS, F.row_number().over(inside).alias("at"), "turn", "role", "text", "n", (fault * 4 + kind).cast("tinyint").alias("code"),
        (F.lag("turn").over(inside).eqNullSafe(F.col("turn")) | F.col("turn").isNull()).alias("same"),
    )


def _blocks(coded: DataFrame) -> DataFrame:
    """One narrow row for each block: codes and copies in order, and what can be counted without the order."""
    fault, n = F.floor(F.col("code") / 4), F.col("n")
    rows = coded.groupBy(*_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("at", "code", "n"))).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum((~F.col("same")).cast("long")).alias("turns"),
        F.sum(F.when(fault == BLANK, n).otherwise(0)).alias("blank"), F.sum(F.when(fault == BLANK, 0).when(fault == DUPLICATE, n).otherwise(n - 1)).alias("duplicate"),
        F.sum((fault == CUT).cast("long")).alias("truncated"),
    )
    return rows.withColumn("codes", F.col("rows.code")).withColumn("copies", F.col("rows.n")).drop("rows")


def _padded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes and copies of a batch's blocks, a row each; -1 beyond a block's end."""
    lists = b.column("codes"), b.column("copies")
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    place = np.arange(max(sizes, default=0)) < sizes[:, None]
    out = np.full(place.shape, -1, np.int64), np.ones(place.shape, np.int64)
    for to, of in zip(out, lists, strict=True):
        to[place] = of.flatten().to_numpy(zero_copy_only=False)
    return out


def _with_inserts(c: np.ndarray) -> np.ndarray:
    """Costs to go (blocks, states, ...) if turns may be inserted first."""
    out = c.copy()
    out[:, USER] = np.minimum(c[:, USER], c[:, ASSISTANT] + INSERT)
    out[:, ASSISTANT] = np.minimum(c[:, ASSISTANT], c[:, USER] + INSERT)
    for s in (START, SYSTEM):
        out[:, s] = np.minimum(c[:, s], out[:, USER] + INSERT)
    return out


def _choices(code: np.ndarray, copies: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What deleting, keeping and rewriting one turn of each block costs from each state on, given the costs after it; far if barred.

    Copies of a turn are duplicates that must be deleted; doing so right after it is least in ASCII and costs the same anywhere.
    """
    shape = (-1, *[1] * (after.ndim - 2))
    kind, fault, copies = (code & 3).reshape(shape), (code >> 2).reshape(shape), copies.reshape(shape)
    delete = after + DELETE * copies[:, None]
    stays = np.where((fault == BLANK) | (fault == DUPLICATE), _FAR, np.where(fault == CUT, TRUNCATED, 0) + DELETE * (copies - 1))
    keep, rewrite = np.full_like(after, _FAR), np.full_like(after, _FAR)
    for s in range(4):
        onward = after[:, ONWARD[s]] + stays
        keep[:, s] = np.where(kind == WHOSE[s], onward, _FAR)
        rewrite[:, s] = onward + REROLE
    keep[:, START] = np.where(kind == 0, after[:, SYSTEM] + stays, keep[:, START])
    return delete, keep, rewrite


def _to_go(codes: np.ndarray, copies: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Backwards over the places of blocks: the place, the costs to go from there, and what each choice costs."""
    c = end
    for k in range(codes.shape[1] - 1, -1, -1):
        choices = _choices(codes[:, k], copies[:, k], c)
        there = (codes[:, k] >= 0).reshape(-1, *[1] * (c.ndim - 1))
        c = np.where(there, np.minimum(_with_inserts(np.minimum(np.minimum(*choices[:2]), choices[2])), _FAR), c)
        yield k, c, choices


def _products(b: pa.RecordBatch) -> list[np.ndarray]:
    """Of each block, the cost from each state in front of it to each state behind."""
    codes, copies = _padded(b)
    c = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(codes), 4, 4))
    for _, c, _ in _to_go(codes, copies, c):
        pass
    return [c.reshape(-1, 16)]


def _walks(b: pa.RecordBatch) -> list[np.ndarray]:
    """Of each block and each state in front of it, the state behind it and, for each turn, its state and letter.

    Among the choices that keep to the cost to go the one least in ASCII is taken: D, I, K, R. A letter is small if a turn is inserted
    before; two never are, as the cheapest edits either keep the next turn then or delete it first.
    """
    codes, copies = _padded(b)
    end = np.array(b.column("behind").to_pylist(), np.int64).reshape(-1, 4)
    steps = list(_to_go(codes, copies, end))[::-1]
    state = np.broadcast_to(np.arange(4), end.shape).copy()
    marks = np.zeros((len(codes), 4, codes.shape[1], 2), np.uint8)
    rows = np.arange(len(codes))[:, None]
    onward = np.array(ONWARD)
    for k, c, (delete, keep, rewrite) in steps:
        marks[:, :, k, 0] = state + 48
        there, inserted = codes[:, k] >= 0, np.zeros_like(state)
        while True:
            best = c[rows, state]
            insert = there[:, None] & (delete[rows, state] != best) & (c[rows, onward[state]] + INSERT == best)
            if not insert.any():
                break
            inserted += insert
            state = np.where(insert, onward[state], state)
        if inserted.max(initial=0) > 1:
            raise AssertionError("two turns inserted before one")
        best = c[rows, state]
        gone = delete[rows, state] == best
        kept = ~gone & (keep[rows, state] == best)
        letter = np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R")))
        marks[:, :, k, 1] = letter + 32 * inserted
        system = kept & (state == START) & (codes[:, k] & 3 == 0)[:, None]
        state = np.where(there[:, None] & ~gone, np.where(system, SYSTEM, onward[state]), state)
    return [state, marks]


def _streamed(blocks: DataFrame, more: str, order: list[Column], step: Callable[[dict, object], tuple[dict, object]], first: object) -> DataFrame:
    """Streams the narrow rows of each conversation in order through step(row, carried), which gives new columns and what is carried on."""
    schema = StructType([*blocks.schema.fields, *StructType.fromDDL(more).fields])
    names = [f.name for f in StructType.fromDDL(more).fields]
    rows = blocks.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried, begun = None, first, False
        types = None
        for b in batches:
            types = types or _arrow_types(schema, names)
            out = []
            for row in b.to_pylist():
                if not begun or row["conv_id"] != now:
                    now, carried, begun = row["conv_id"], first, True
                new, carried = step(row, carried)
                out.append(new)
            columns = [pa.array([r[c] for r in out], t) for c, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _arrow_types(schema: StructType, names: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(schema[c].dataType) for c in names]


def _chained(row: dict, behind: list[int] | None) -> tuple[dict, list[int]]:
    """The costs to go behind a block, and those in front of it, which stand behind the block before."""
    last, behind, p = behind is None, behind or AT_END.tolist(), row["product"]
    return {"behind": behind, "last": last}, [min(p[4 * s + t] + behind[t] for t in range(4)) for s in range(4)]


def _chosen(row: dict, carried: tuple[int, int | None]) -> tuple[dict, tuple[int, int | None]]:
    """The walk of a block from the state that the blocks before have led to, its letters, and adjacent roles that the grammar lacks."""
    state, last = carried
    marks = row["walks"][state]
    kinds = [c & 3 for c in row["codes"]]
    pairs = zip([last, *kinds], kinds, strict=False)
    illegal = sum(a is not None and (a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in pairs) + sum(row["copies"]) - len(kinds)
    audit = "".join(("I" if m > "Z" else "") + m.upper() + "D" * (n - 1) for m, n in zip(marks[1::2], row["copies"], strict=True))
    left = row["states"][state]
    return {"entry": state, "marks": marks, "illegal": illegal, "letters": audit, "left": left, "head": last is None}, (left, kinds[-1])


def _mapped(df: DataFrame, more: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    schema = StructType([*df.schema.fields, *StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], names=schema.names)

    return df.mapInArrow(run, schema)


def planned(blocks: DataFrame) -> DataFrame:
    """The rows of _blocks with the edits of each: entry state, marks (a state and a letter for each turn), letters, state left, and cost, the
    whole conversation's, on its first block."""
    products = _mapped(blocks, "product array<long>", lambda b: [pa.array(_products(b)[0].tolist(), pa.list_(pa.int64()))])
    back = _streamed(products, "behind array<long>, last boolean", [F.col("block").desc_nulls_last()], _chained, None)

    def walks(b: pa.RecordBatch) -> list[pa.Array]:
        state, marks = _walks(b)
        sizes = b.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        told = [[marks[i, s, : sizes[i]].tobytes().decode() for s in range(4)] for i in range(len(b))]
        return [pa.array(state.tolist(), pa.list_(pa.int64())), pa.array(told, pa.list_(pa.string()))]

    # dealt anew by block, so that the blocks of one long conversation are walked by many tasks
    dealt = back.repartition(partitions(blocks.sparkSession), *_KEYS)
    walked = _mapped(dealt, "states array<long>, walks array<string>", walks)
    out = _streamed(walked, "entry long, marks string, illegal long, letters string, left long, head boolean", [F.col("block").asc_nulls_first()], _chosen, (START, None))
    total = F.least(*[F.element_at("product", 1 + t) + F.element_at("behind", 1 + t) for t in range(4)])
    return out.withColumn("cost", F.when(F.col("head"), total)).drop("head", "product", "behind", "walks", "states", "codes", "copies")


def _role(state: Column) -> Column:
    return F.when(state == USER, "assistant").otherwise("user")


def _turns(coded: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, block, at, place (0 for an inserted turn), edit, role and text, in this order."""
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in _KEYS], "marks")
    rows = coded.join(plan, F.col("conv_id").eqNullSafe(F.col("plan_conv_id")) & F.col("block").eqNullSafe(F.col("plan_block")))
    mark, state = F.substring("marks", 2 * F.col("at"), F.lit(1)), F.substring("marks", 2 * F.col("at") - 1, F.lit(1)).cast("int")
    rows = rows.select(*_KEYS, "at", "role", "text", F.upper(mark).alias("edit"), (F.lower(mark) == mark).alias("led"), state.alias("state"))
    then = F.when(F.col("led"), F.when(F.col("state") == USER, ASSISTANT).otherwise(USER)).otherwise(F.col("state"))
    made = F.array(
        F.when(F.col("led"), F.struct(F.lit(0).alias("place"), F.lit("I").alias("edit"), _role(F.col("state")).alias("role"), F.lit("").alias("text"))),
        F.when(F.col("edit") != "D", F.struct(F.lit(1).alias("place"), F.col("edit"), F.when(F.col("edit") == "K", F.col("role")).otherwise(_role(then)).alias("role"), F.col("text"))),
    )
    return rows.select(*_KEYS, "at", F.inline(F.filter(made, lambda x: x.isNotNull())))


def _tails(plan: DataFrame) -> DataFrame:
    """The turns inserted behind conversations, as _turns gives them."""
    rows = plan.where("last").select(*_KEYS, F.explode(F.split(F.element_at(F.array(*map(F.lit, TAIL)), (F.col("left") + 1).cast("int")), "")).alias("who"))
    rows = rows.where(F.col("who") != "")
    return rows.select(*_KEYS, F.lit(None).cast("int").alias("at"), F.when(F.col("who") == "u", 0).otherwise(1).alias("place"), F.lit("I").alias("edit"), F.when(F.col("who") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))


def _prepared(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The coded turns and the plans of their blocks, both written."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    coded = written(_coded(df.select("conv_id", "turn", space("role"), space("text"))), "turns")
    return coded, written(planned(_blocks(coded)), "edits")


def repaired_turns(df: DataFrame) -> DataFrame:
    """The turns of each conversation of df (conv_id, turn, role, text) after the cheapest edits, as conv_id, block, at, place, edit, role and
    text; ordered by block (nulls first), at (nulls last) and place within a conversation.

    Turns come by number (null first), then role, then text. A null role or text is one space, null ids are one conversation, and of
    equal turns all but the first are duplicates. Other columns are left out; an empty table gives an empty result. No conversation goes to
    one task whole: turns are dealt by blocks of turn numbers, and only a few numbers for each block are streamed in order. Turns of one
    number, or without any, that differ in role or text are one block.
    """
    coded, plan = _prepared(df)
    return _turns(coded, plan).unionByName(_tails(plan))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of the lines `role:text` of repaired_turns. A digest is sequential: each conversation is a stream of
    one task, which holds no more than a batch of it."""
    rows = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_first(), F.col("at").asc_nulls_last(), "place")
    rows = rows.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, kind = None, None, None
        for b in batches:
            kind = b.schema.field(0).type
            ids, out = b.column(0).to_pylist(), []
            for key, line in zip(ids, b.column(1).to_pylist(), strict=True):
                if h is None or key != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(line.encode())
                else:
                    h.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out])], names=schema.names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], names=schema.names)

    return rows.mapInArrow(run, schema)


def repaired(df: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of df: gaps in its turn numbers, blank, duplicate and truncated turns (each turn's first fault), illegal
    neighbours, the cost and letters (audit) of the cheapest edits, and repaired_sha256; what repaired_turns states holds.

    everyone (conv_id) adds conversations without any turn: zeros, no audit, the digest of nothing. The audit of a conversation, a
    letter for each edit, is put together in one row.
    """
    coded, plan = _prepared(df)
    told = plan.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block").isNotNull(), "block", "letters"))), lambda x: x["letters"]), ""), F.max(F.when(F.col("last"), F.when(F.col("left") == SYSTEM, "II").when(F.col("left") == USER, "I").otherwise("")))).alias("audit"),
    )
    hashed = digests(_turns(coded, plan).unionByName(_tails(plan))).withColumnRenamed("conv_id", "hashed_id")
    out = told.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left").drop("hashed_id")
    if everyone is not None:
        out = everyone.select(F.col("conv_id").alias("any_id")).join(out, F.col("any_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("any_id", "conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = written(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repaired")
    dropped(coded, plan)
    return out
