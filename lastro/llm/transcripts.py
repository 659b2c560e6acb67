"""Transcripts parsed by a hidden Markov model, then rendered as canonical turns.

A line's hidden state is its speaker's role and whether it begins a turn. What is seen of a line is the
kind of its speaker marker, its length class, whether it asks and whether it follows a blank. The model's
counts are taken from labelled transcripts; Viterbi recovers the states, and each run from a beginning to
the next is one turn.

A long transcript is cut into blocks of ``BLOCK_TURNS`` turns. A block knows whether the line before it is
blank and that line's label. Its best scores from each state to each state are a small matrix; chaining the
blocks' matrices gives the states at the block ends, exactly as one pass over the whole transcript would, so
no task holds a whole transcript and the block length changes no result.

Defined results: null and empty texts are one empty line; a null turn lies before all others, ties go by
role and text; lines of a null or unknown role, and moves from or to them, are not learned from; a null
conversation id is a transcript of its own; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROLES = ("system", "user", "assistant")
#: Spellings of a speaker marker, by role.
MARKERS = {
    "system": ("System:", "SYSTEM:", "[system]", "<|system|>"),
    "user": ("User:", "Human:", "Q:", "<|user|>"),
    "assistant": ("Assistant:", "AI:", "A:", "<|assistant|>"),
}
STATES = 2 * len(ROLES)  # role x (begins, goes on)
LENGTHS = (0, 20, 60, 120, 240, 480)
FEATURES = (len(ROLES) + 1, len(LENGTHS) + 1, 2, 2)
BLOCK_TURNS = 128
_marker = re.compile("|".join(f"(?P<{role}>{'|'.join(map(re.escape, spelt))})" for role, spelt in MARKERS.items()), re.IGNORECASE)


#: A line of these alone is blank.
BLANKS = " \t\n\x0b\f\r"


def observe(lines: list[str], after_blank: bool = False) -> np.ndarray:
    """What is seen of each line, a row of feature values; ``after_blank``: of the line before them."""
    seen = np.zeros((len(lines), len(FEATURES)), np.int64)
    for at, line in enumerate(lines):
        found = _marker.match(line.lstrip())
        seen[at] = (
            ROLES.index(found.lastgroup) + 1 if found else 0,
            sum(len(line) > n for n in LENGTHS),
            line.rstrip().endswith("?"),
            not lines[at - 1].strip(BLANKS) if at else after_blank,
        )
    return seen


class LineModel:
    """Log probabilities from counts, each one more than was seen."""

    def __init__(self, counts: np.ndarray) -> None:
        at = STATES + STATES * STATES
        self.start = np.log((counts[:STATES] + 1) / (counts[:STATES] + 1).sum())
        moves = counts[STATES:at].reshape(STATES, STATES) + 1
        self.moves = np.log(moves / moves.sum(1, keepdims=True))
        self.emit = []
        for values in FEATURES:
            table = counts[at : at + STATES * values].reshape(STATES, values) + 1
            self.emit.append(np.log(table / table.sum(1, keepdims=True)))
            at += STATES * values

    def emissions(self, lines: list[str], after_blank: bool = False) -> np.ndarray:
        seen = observe(lines, after_blank)
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emit))

    def transfer(self, lines: list[str], opens: bool = False, after_blank: bool = False) -> np.ndarray:
        """Best score from each state before the lines to each state at their end; if they open a transcript, from its start."""
        rows = self.emissions(lines, after_blank)
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        if opens:
            best, rows = np.broadcast_to(self.start + rows[0], (STATES, STATES)), rows[1:]
        for row in rows:
            best = (best[:, :, None] + self.moves[None]).max(1) + row
        return best

    def decode(self, lines: list[str], before: int, end: int, after_blank: bool = False) -> list[int]:
        """States of the lines, from state ``before`` (-1: a transcript's start) to ``end`` (-1: the best)."""
        rows, back = self.emissions(lines, after_blank), []
        best = None
        for row in rows:
            if best is None:
                best = (self.start if before < 0 else self.moves[before]) + row
                continue
            came = best[:, None] + self.moves
            back.append(came.argmax(0))
            best = came.max(0) + row
        path = [int(best.argmax()) if end < 0 else end]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


COUNTS = STATES + STATES * STATES + STATES * sum(FEATURES)


def count_lines(lines: list[str], states: list[int], before: int | None, after_blank: bool = False) -> np.ndarray:
    """Starts, moves and features of a block of labelled lines; ``before``: the label of the line before, None at a start.

    Lines without a label (-1) are not counted.
    """
    counts = np.zeros(COUNTS, np.int64)
    if before is None and states[0] >= 0:
        counts[states[0]] += 1
    for a, b in pairwise([-1 if before is None else before, *states]):
        if a >= 0 and b >= 0:
            counts[STATES + a * STATES + b] += 1
    labels = np.array(states, np.int64)
    at, seen = STATES + STATES * STATES, observe(lines, after_blank)[labels >= 0]
    for k, values in enumerate(FEATURES):
        counts[at : at + STATES * values] += np.bincount(labels[labels >= 0] * values + seen[:, k], minlength=STATES * values)
        at += STATES * values
    return counts


def transcript_lines(turns: DataFrame, marked: Column | None = None) -> DataFrame:
    """(conv_id, block, lines, states, offset, after_blank, before): staged blocks of transcript lines from turns (conv_id, turn, role, text).

    offset: lines before the block; before: the label of the line before it, null at a transcript's start.
    A turn's first line gets a spelling of its speaker's marker, by a hash of the turn, where ``marked`` holds
    (three turns of four unless given); the roles themselves are seen by no one but the learner, in ``states``.
    """
    h = F.pmod(F.xxhash64("conv_id", "turn", F.coalesce("text", F.lit(""))), F.lit(16)).cast("int")
    spelling = F.lit(None)
    for role, spelt in MARKERS.items():
        spelling = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(x) for x in spelt]), h % len(spelt) + 1)).otherwise(spelling)
    marker = F.when(h >= 4 if marked is None else marked, spelling)
    first = F.struct(F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.concat(marker, F.lit(" ")), F.lit("")).alias("marker"))
    block = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS).cast("long")
    blocks = turns.select("conv_id", block.alias("block"), first.alias("t")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    role = lambda r: sum((F.when(r == x, 2 * k).otherwise(0) for k, x in enumerate(ROLES)), F.lit(0))
    known = lambda r: r.isin(*ROLES)
    lines = F.flatten(F.transform("t", lambda t: F.split(F.concat(t["marker"], t["text"]), "\n")))
    states = F.flatten(F.transform("t", lambda t: F.transform(F.split(t["text"], "\n"), lambda _, i: F.when(known(t["role"]), role(t["role"]) + F.when(i == 0, 0).otherwise(1)).otherwise(-1))))
    blocks = stage(blocks.select("conv_id", "block", lines.alias("lines"), states.alias("states")), "transcript-blocks")
    last = F.element_at("lines", -1)
    ends = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.size("lines").alias("n"), (~last.rlike(r"[^ \t\n\x0B\f\r]")).alias("blank"), F.element_at("states", -1).alias("state"))
    earlier = Window.partitionBy("c").orderBy("k")  # of a row for each block
    offset = F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("c", "k", offset.alias("offset"), F.coalesce(F.lag("blank").over(earlier), F.lit(False)).alias("after_blank"), F.lag("state").over(earlier).alias("before"))
    return blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).drop("c", "k")


def learn(blocks: DataFrame) -> LineModel:
    """The model of labelled blocks (lines, states, before, after_blank)."""

    @F.arrow_udf("array<long>")
    def counted(lines: pa.Array, states: pa.Array, before: pa.Array, after_blank: pa.Array) -> pa.Array:
        rows = zip(lines, states, before.to_pylist(), after_blank.to_pylist(), strict=True)
        total = sum((count_lines(a.as_py(), b.as_py(), c, d) for a, b, c, d in rows), np.zeros(COUNTS, np.int64))
        return pa.array([total.tolist() if at == 0 else [] for at in range(len(lines))], pa.list_(pa.int64()))

    sums = blocks.select(F.posexplode(counted("lines", "states", "before", "after_blank")).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTS)
    for r in sums.collect():  # COUNTS rows at most
        counts[r["at"]] = r["n"]
    return LineModel(counts)


def recover_states(blocks: DataFrame, model: LineModel) -> DataFrame:
    """``blocks`` with recovered: array<int>, the most probable states of each transcript's lines."""

    @F.arrow_udf("array<double>")
    def transfer(lines: pa.Array, opens: pa.Array, after_blank: pa.Array) -> pa.Array:
        rows = zip(lines, opens.to_pylist(), after_blank.to_pylist(), strict=True)
        return pa.array([model.transfer(x.as_py(), o, a).ravel().tolist() for x, o, a in rows], pa.list_(pa.float64()))

    @F.arrow_udf("array<int>")
    def chain(matrices: pa.Array) -> pa.Array:
        out = []
        for x in matrices:
            blocks_of, back = [np.array(m).reshape(STATES, STATES) for m in x.as_py()], []
            best = None
            for m in blocks_of:
                came = (np.zeros(STATES) if best is None else best)[:, None] + m
                back.append(came.argmax(0))
                best = came.max(0)
            ends = [int(best.argmax())]
            for step in reversed(back[1:]):
                ends.append(int(step[ends[-1]]))
            out.append(ends[::-1])
        return pa.array(out, pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def decode(lines: pa.Array, entry: pa.Array, end: pa.Array, after_blank: pa.Array) -> pa.Array:
        rows = zip(lines, entry.to_pylist(), end.to_pylist(), after_blank.to_pylist(), strict=True)
        return pa.array([model.decode(x.as_py(), b, e, a) for x, b, e, a in rows], pa.list_(pa.int32()))

    one = blocks.select("conv_id", "block", transfer("lines", F.col("offset") == 0, "after_blank").alias("m"))
    chained = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("b"))
    ends = chained.select("conv_id", F.col("b.block").alias("blocks"), chain(F.col("b.m")).alias("ends"))
    ends = ends.select("conv_id", F.posexplode("blocks").alias("at", "block"), "ends")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.when(F.col("at") == 0, -1).otherwise(F.try_element_at("ends", F.greatest("at", F.lit(1)))).alias("entry"), F.element_at("ends", F.col("at") + 1).alias("end"))
    joined = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).drop("c", "k")
    return joined.withColumn("recovered", decode("lines", "entry", "end", "after_blank")).drop("entry", "end")


def render_turns(blocks: DataFrame) -> DataFrame:
    """(conv_id, first_line, role, n_lines, n_right, rendered): a row for each recovered turn, markers taken off."""
    begins = F.col("state") % 2 == 0
    lines = blocks.select("conv_id", "block", "offset", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), F.col("recovered").alias("state"), F.col("states").alias("true"))).alias("at", "x")).select("conv_id", "block", (F.col("offset") + F.col("at")).alias("at"), "x.*")
    here = Window.partitionBy("conv_id", "block").orderBy("at")
    lines = lines.withColumn("begun", F.last(F.when(begins, F.col("at")), True).over(here))
    ends = lines.groupBy("conv_id", "block").agg(F.max("begun").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce(F.last("last", True).over(earlier), F.lit(0)).alias("carried"))
    lines = lines.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).withColumn("turn", F.coalesce("begun", "carried"))
    marker = r"(?i)^\s*(" + "|".join(re.escape(x).replace("<\\|", "<\\|") for spelt in MARKERS.values() for x in spelt) + r")\s*"
    ordered = F.array_sort(F.collect_list(F.struct("at", "line", "state")))
    turns = lines.groupBy("conv_id", "turn").agg(ordered.alias("l"), F.count("*").alias("n_lines"), F.count_if(F.col("state") == F.col("true")).alias("n_right"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.element_at("l", 1)["state"] / 2) + 1).cast("int"))
    text = F.regexp_replace(F.array_join(F.col("l.line"), "\n"), marker, "")
    return turns.select("conv_id", F.col("turn").cast("long").alias("first_line"), role.alias("role"), F.col("n_lines").cast("long"), F.col("n_right").cast("long"), F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


def fold(conv_id: str, modulus: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(conv_id).cast("string"), F.lit("")).cast("binary")) % modulus


def canonical_turns(turns: DataFrame, held_out: int = 2) -> DataFrame:
    """Recovered turns of every conversation; the model is learned from the conversations outside fold ``held_out``."""
    blocks = stage(transcript_lines(turns), "transcripts")
    model = learn(blocks.where(fold("conv_id") != held_out))
    found = render_turns(recover_states(blocks, model))
    return found.withColumn("held_out", fold("conv_id") == held_out)
