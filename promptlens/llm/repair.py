"""Cheapest repairs of conversations, read from an automaton of their roles and faults that shares suffixes."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptlens.llm.graph import _kept
from promptlens.llm.sequence import digest, numbered

#: Rows of a conversation that form one word of the automaton; longer ones are several, counted from the end.
BLOCK = 256

# --- fixed values: the grammar (s?(ua)+)? and the costs of edits ---
START, SYSTEM, USER, PAIR = range(4)  # nothing yet; after s; after u; after a
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
# ---

FAR = 1 << 40
#: What each state still costs at the end of a conversation, and the inserts that pay for it.
END = (0, 2 * INSERT, INSERT, 0)
CLOSING = ("", "ua", "a", "")

# Edits are letters within the automaton: D delete, K keep, U and A rerole, u and a insert.


def _node(symbol: str, after: tuple) -> tuple:
    """(cost to go, edits, state at the block's end) of each grammar state, one symbol before ``after``.

    Edits of equal cost differ in their shown letter, which settles ties: D, I, K, R.
    """
    role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    base = []
    for state in range(4):
        ways = [(after[state][0] + DELETE, "D", "D", after[state])]
        if symbol != "D":
            if role in NEXT[state]:
                ways.append((after[NEXT[state][role]][0] + KEEP + late, "K", "K", after[NEXT[state][role]]))
            to = "a" if state == USER else "u"
            then = after[NEXT[state][to]]
            ways.append((then[0] + REROLE + late, "R", to.upper(), then))
        base.append(min(ways, key=lambda w: w[:2]))

    def best(state: int, inserts: int) -> tuple:
        cost, shown, code, then = base[state]
        out = (cost, shown, code + then[1], then[2])
        if inserts:
            to = "a" if state == USER else "u"
            more = best(NEXT[state][to], inserts - 1)
            out = min(out, (more[0] + INSERT, "I", to + more[2], more[3]), key=lambda w: w[:2])
        return out

    # a third insert in a row would only repeat a state
    return tuple((min(w[0], FAR), w[2], w[3]) for w in (best(s, 2) for s in range(4)))


_FOUND = pa.schema([("goal", pa.string()), ("word", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by goal and, read backward, by letters: each shared suffix's nodes are computed once."""
    goal, done, nodes = None, "", []
    for batch in batches:
        out = []
        for g, back in zip(batch.column("goal").to_pylist(), batch.column("back").to_pylist()):
            if g != goal:
                goal, done = g, ""
                nodes = [tuple((int(c), "", s) for s, c in enumerate(g.split(",")))]
            same = 0
            while same < min(len(done), len(back)) and done[same] == back[same]:
                same += 1
            del nodes[same + 1 :]
            for symbol in back[same:]:
                nodes.append(_node(symbol, nodes[-1]))
            done = back
            out.append((g, back[::-1], *map(list, zip(*nodes[-1]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 5, _FOUND)], schema=_FOUND)


def automaton(words: DataFrame) -> DataFrame:
    """(goal, word, costs, edits, states) of each distinct word and goal, by grammar state before the word.

    ``goal`` lists what each state costs after the word ("0,4,2,0" at a conversation's end). Words are spread by
    their letters from the end, so those that share a suffix meet, and its nodes are made once for all of them
    (a suffix that straddles two tasks: once in each).
    """
    words = words.select("goal", "word").distinct().select("goal", F.reverse("word").alias("back"))
    return words.repartitionByRange("goal", "back").sortWithinPartitions("goal", "back").mapInArrow(_walk, "goal string, word string, costs array<long>, edits array<string>, states array<int>")


def _goal(costs: tuple) -> str:
    return ",".join(map(str, costs))


_UNITS = [_goal(tuple(0 if s == to else FAR for s in range(4))) for to in range(4)]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of each conversation: what each state costs after the block.

    Costs are given above the least one, so few goals differ; ``above`` is what was taken off.
    """
    key, costs, above = None, END, 0
    for batch in batches:
        rows = batch.to_pydict()
        goals, offs = [], []
        for k, steps in zip(rows["k"], rows["steps"]):
            if k != key:
                key, costs, above = k, END, 0
            goals.append(_goal(costs))
            offs.append(above)
            if steps is not None:  # another block comes before
                costs = [min(steps[to][state] + costs[to] for to in range(4)) for state in range(4)]
                least = min(costs)
                above += least
                costs = tuple(min(c - least, FAR) for c in costs)
        yield pa.RecordBatch.from_pydict({"k": rows["k"], "block": rows["block"], "word": rows["word"], "goal": goals, "above": offs}, schema=_GOALS)


_GOALS = pa.schema([("k", pa.string()), ("block", pa.int64()), ("word", pa.string()), ("goal", pa.string()), ("above", pa.int64())])
_CODES = pa.schema([("k", pa.string()), ("block", pa.int64()), ("code", pa.string()), ("cost", pa.int64())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last: the edits of each, and at the first block the cost of all."""
    key, state = None, START
    for batch in batches:
        rows = batch.to_pydict()
        codes, costs = [], []
        for k, block, above, cost, edits, states in zip(*(rows[c] for c in ("k", "block", "above", "costs", "edits", "states"))):
            if k != key:
                key, state = k, START
                costs.append(cost[state] + above)
            else:
                costs.append(None)
            code, state = edits[state], states[state]
            codes.append(code if block else code + CLOSING[state])
        yield pa.RecordBatch.from_pydict({"k": rows["k"], "block": rows["block"], "code": codes, "cost": costs}, schema=_CODES)


def _edits(blocks: DataFrame) -> DataFrame:
    """(k, block, code, cost) of blocks (k, block, word, first): block 0 is a conversation's last."""
    before = blocks.where("not first").select("word")
    units = F.explode(F.array(*map(F.lit, _UNITS))).alias("goal")
    steps = automaton(before.distinct().select("word", units)).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("goal", "costs"))).alias("m"))
    steps = steps.select("word", F.array(*(F.col("m")[u] for u in _UNITS)).alias("steps"), F.lit(False).alias("first"))
    rows = blocks.join(steps, ["word", "first"], "left").select("k", "block", "word", "steps")
    goals = rows.repartition("k").sortWithinPartitions("k", "block").mapInArrow(_backward, "k string, block long, word string, goal string, above long")
    goals = _kept(goals, "goals")
    found = goals.join(automaton(goals), ["goal", "word"])
    return found.select("k", "block", "above", "costs", "edits", "states").repartition("k").sortWithinPartitions("k", F.desc("block")).mapInArrow(_forward, "k string, block long, code string, cost long")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each block's edits just before its rows, to the repaired turns in order."""
    key, codes, code, at = None, deque(), "", 0
    held: list[tuple] = []
    kind = pa.schema([("k", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def inserted(k: str) -> None:
        nonlocal at
        while at < len(code) and code[at] in "ua":
            held.append((k, "user" if code[at] == "u" else "assistant", ""))
            at += 1

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*held) if held else [[]] * 3)], schema=kind)
        held.clear()
        return out

    for batch in batches:
        rows = batch.to_pydict()
        for k, next_code, role, text in zip(rows["k"], rows["code"], rows["role"], rows["text"]):
            if k != key:
                if key is not None:
                    inserted(key)
                key, code, at = k, "", 0
                codes.clear()
            if next_code is not None:
                codes.append(next_code)
                continue
            while at == len(code):
                code, at = codes.popleft(), 0
            inserted(k)
            edit, at = code[at], at + 1
            if edit != "D":
                held.append((k, {"K": role, "U": "user", "A": "assistant"}[edit], text))
        yield flush()
    if key is not None:
        inserted(key)
    yield flush()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """The cheapest audit of each conversation, and its repaired turns.

    ``turns`` has conv, turn, ``role`` and ``text``; rows follow by turn, nulls first, and where turns tie by the digest of
    role and text. A row's first fault counts: blank (white space alone), duplicate (role and text stood earlier), truncated (not
    ended by . ! or ?). Edits give role initials (s?(ua)+)?: keep 0; rerole to user or assistant 2; delete 3, which blank and
    duplicate rows must be; insert an empty user or assistant turn 2; a truncated row that stays costs 1. Of the cheapest
    the least in letters is taken. A role with no initial, or another than s, u or a, can't be kept. Null roles and texts count as
    one space; a null conv is a conversation of its own.

    Returns (k, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation with rows, ``k`` being conv as text
    ('' for null), and the turns (k, role, text): all of one k lie in one partition, in their order. Other columns never matter.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("k"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim("text", F.lit(WHITE))
    last = F.right(end, F.lit(1))
    rows = rows.withColumn("digest", digest(F.col("role"), F.col("text")))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    facts = rows.select(
        "k", "turn", "digest", F.left("role", F.lit(1)).alias("initial"), (F.length(end) == 0).alias("blank"),
        (~last.isin(".", "!", "?")).alias("late"),
    )
    facts = _kept(numbered(facts, "k", order), "turn-facts")
    first = facts.groupBy("k", "digest").agg(F.min("pos").alias("pos")).select("k", "pos", F.lit(True).alias("new"))
    facts = facts.join(first, ["k", "pos"], "left").withColumn("again", F.col("new").isNull() & ~F.col("blank"))
    late = F.col("late") & ~F.col("blank") & ~F.col("again")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("blank") | F.col("again"), "D").when(late, F.upper(initial)).otherwise(initial)
    from_end = F.col("total") - F.col("pos")
    facts = facts.select("k", "pos", "turn", "digest", initial.alias("initial"), symbol.alias("symbol"), "blank", "again", late.alias("late"), F.floor(from_end / BLOCK).alias("block"), (from_end % BLOCK == BLOCK - 1).alias("edge"))
    # the first row of a block also ends the block before, for the pair that the two rows form
    places = F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")), F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))
    places = F.when(F.col("edge") & (F.col("pos") > 1), places).otherwise(F.slice(places, 1, 1))
    spread = facts.withColumn("place", F.explode(places)).drop("block", "edge").select("*", "place.block", "place.own").drop("place")
    own = F.col("own")
    letters = F.array_sort(F.collect_list(F.struct("pos", "initial", F.when(own, F.col("symbol")).otherwise("").alias("symbol"))))
    blocks = spread.groupBy("k", "block").agg(
        letters.alias("rows"), *(F.count_if(F.col(c) & own).alias(c) for c in ("blank", "again", "late")),
        F.min(F.when(own, F.struct("pos", "turn", "digest"))).alias("start"),
    )
    spoken = F.array_join("rows.initial", "")
    legal = F.aggregate(F.sequence(F.lit(1), F.length(spoken)), F.lit(0), lambda n, i: n + F.substring(spoken, i, F.lit(2)).isin("su", "ua", "au").cast("int"))
    blocks = blocks.withColumn("word", F.array_join("rows.symbol", "")).withColumn("illegal", (F.length(spoken) - 1 - legal).cast("long"))
    blocks = _kept(blocks.withColumn("first", F.col("start.pos") == 1).drop("rows"), "blocks")
    edits = _kept(_edits(blocks.select("k", "block", "word", "first")), "edits")
    spans = facts.where("turn is not null").groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    shown = F.translate("code", "UAua", "RRII")
    audits = edits.groupBy("k").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("block")).alias("at"), shown.alias("shown")))), lambda x: x["shown"]), "").alias("audit"))
    counts = blocks.groupBy("k").agg(F.sum("blank").alias("blank"), F.sum("again").alias("duplicate"), F.sum("late").alias("truncated"), F.sum("illegal").alias("illegal"))
    audits = counts.join(audits, "k").join(spans, "k", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))
    codes = edits.join(blocks.select("k", "block", "start"), ["k", "block"]).select("k", "start.turn", "start.digest", F.lit(0).alias("kind"), F.col("start.pos").alias("pos"), "code", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    lines = rows.select("k", "turn", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("code"), "role", "text")
    together = codes.unionByName(lines).repartition("k").sortWithinPartitions("k", *order, "kind", "pos")
    return audits, together.select("k", "code", "role", "text").mapInArrow(_applied, "k string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running = None, None
    kind = pa.schema([("k", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "role", "text"))):
            if k != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(role.encode() + b":" + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done) if done else [[], []])], schema=kind)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], schema=kind)


def fingerprints(repaired: DataFrame) -> DataFrame:
    """(k, repaired_sha256) over ``role:text`` lines, in the partitions and order that ``repair`` left."""
    return repaired.mapInArrow(_digests, "k string, repaired_sha256 string")
