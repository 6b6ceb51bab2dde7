"""Transcript parsing with a hidden Markov model over lines, and canonical rendering of turns.

A state is a role together with "first line" or "further line". Blank lines are not observed: a line's
features are the speaker marker that opens it, whether a blank line stands before it, its length class and its
closing mark; given the state they are taken as independent. Start, transition and feature probabilities are smoothed counts over labelled
conversations: aggregates of a few hundred rows, whatever the corpus. The best path is found by
Viterbi, first state in order on ties.

Blocks are numbered in their conversation and cut to segments of `span` blocks. A conversation of one
segment is decoded as it is. Of a longer one, each segment reduces to a max-plus matrix (best score from
any state before it to any state after it). Matrices are multiplied in groups of `fan`, level by level, until one
is left for each conversation; the best end is then handed down, group by group, as an entry vector
and an exit state for every segment, which are decoded on their own. A turn that crosses segments is put together again.
So the outcome is that of Viterbi over the whole conversation, whatever `span`, and no task holds
more than some segments of about `group_bytes` together, or one group of matrices. Segments of a task are decoded in lockstep.

Blank lines inside a turn stay; those around it go. Null text is an empty line; null roles are not learned; a row
with a null conv_id is a conversation of its own. Blocks are ordered by turn, null turns first, then by a hash of
their text and the text; turns may be negative or repeated. Blocks without a line that is not blank hold no turn. Very long
texts and conversations are taken whole. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import shuffle_partitions, ship, written
from rootweave.operators.ordered import Runs

ROLES = ("system", "user", "assistant")
#: Speaker markers at the start of a line, with the class that each suggests.
MARKER = re.compile(r"\s*(?:#+\s*|<\|?|\[)?\s*(system|user|human|q|question|prompter|assistant|ai|bot|a|answer|gpt|[^\W\d_][\w .-]{0,19}(?=:))\s*(?:\|?>|\]|:)+[ \t]*", re.IGNORECASE)
_CLASS = {"system": 1, "user": 2, "human": 2, "q": 2, "question": 2, "prompter": 2, "assistant": 3, "ai": 3, "bot": 3, "a": 3, "answer": 3, "gpt": 3}
#: Sizes of the features: marker class (none, three roles, other name), blank line before, length class, closing mark.
FEATURES = (5, 2, 6, 4)
STATES = 2 * len(ROLES)  # role * 2 + (0: first line, 1: further line)
START = STATES


def features(line: str, gap: bool) -> tuple[int, int, int, int]:
    found = MARKER.match(line)
    marker = _CLASS.get(found[1].lower(), 4) if found else 0
    rest = line[found.end() :] if found else line
    bare = rest.strip()
    length = 0 if not bare else min(5, 1 + len(bare).bit_length() // 2)
    closing = 0 if not bare else 1 + ("?.".find(bare[-1]) + 1 if bare[-1] in "?." else 0)
    return marker, int(gap), length, closing


def observed(text: str) -> list[tuple[int, str, int]]:
    """Number and text of the lines of a block that are not blank, and how many blank lines stand before each."""
    found, blanks = [], 0
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            found.append((i, line, blanks))
            blanks = 0
        else:
            blanks += 1
    return found


def without_marker(line: str) -> str:
    found = MARKER.match(line)
    return line[found.end() :] if found and found[1].lower() in _CLASS else line


@dataclass
class TurnModel:
    move: np.ndarray  # log probabilities, STATES + 1 by STATES + 1; START has no way in
    emit: list[np.ndarray]  # one for each feature, STATES by its size

    def scores(self, table: np.ndarray) -> np.ndarray:
        """A row for each line: the log probability of its features in every state."""
        return sum(self.emit[k][:, table[:, k]].T for k in range(len(FEATURES)))

    def matrices(self, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Max-plus matrices of sequences of lines that follow each other in the table."""
        out = np.broadcast_to(np.where(np.eye(START + 1, dtype=bool), 0.0, -np.inf), (len(lengths), START + 1, START + 1)).copy()
        for live, rows in _lockstep(self.scores(table), lengths):
            best = (out[live][:, :, :, None] + self.move).max(axis=2)
            best[:, :, :STATES] += rows[:, None, :]
            out[live] = best
        return out

    def decode(self, table: np.ndarray, lengths: np.ndarray, entry: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """States of all lines; a sequence starts from its entry vector and ends in its exit state, or (-1) the best one."""
        at, steps = entry.copy(), []
        for live, rows in _lockstep(self.scores(table), lengths):
            options = at[live][:, :, None] + self.move
            steps.append((live, options.argmax(axis=1).astype(np.int8)))
            best = options.max(axis=1)
            best[:, :STATES] += rows
            at[live] = best
        state = np.where(exits < 0, at.argmax(axis=1), exits)
        path = np.zeros(len(table), dtype=np.int8)
        first = np.cumsum(lengths) - lengths
        for t in range(len(steps) - 1, -1, -1):
            live, came = steps[t]
            path[first[live] + t] = state[live]
            state[live] = came[np.arange(len(live)), state[live]]
        return path


def _lockstep(scores: np.ndarray, lengths: np.ndarray):
    """For every step the sequences that are that long, and their rows at it."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    for t, n in enumerate(live.tolist()):
        yield order[:n], scores[first[order[:n]] + t]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def opening() -> np.ndarray:
    return np.where(np.arange(START + 1) == START, 0.0, -np.inf)


def raw_blocks(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, text, role: turns as raw transcripts show them.

    A conversation has one of four marker styles; one turn in five has lost its marker. Style 2 has no
    blank line between turns.
    """
    ship(conversations.sparkSession)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    style = F.crc32(F.concat(F.lit("style:"), key).cast("binary")) % 4
    lost = F.crc32(F.concat_ws(":", key, F.col("turn").cast("string")).cast("binary")) % 5 == 0
    names = {0: ("System: ", "User: ", "Assistant: "), 1: ("### System:\n", "### Human:\n", "### Assistant:\n"), 2: ("[system] ", "Q: ", "A: "), 3: ("<system> ", "<user> ", "<assistant> ")}
    marker = F.lit("")
    for number, words in names.items():
        for role, word in zip(ROLES, words, strict=True):
            marker = F.when((style == number) & (F.col("role") == role) & ~lost, F.lit(word)).otherwise(marker)
    gap = F.when(style == 2, F.lit("")).otherwise(F.lit("\n"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(gap, marker, F.coalesce("text", F.lit(""))).alias("text"), F.col("role").cast("string").alias("role"),
    )


def ordered(blocks: DataFrame) -> DataFrame:
    """The blocks with `conv`, a key of the conversation, and `n`, the place in it; written once.

    No task orders a whole conversation: turns are numbered in buckets of 4,096, null turns in buckets of their hash.
    """
    keyed = blocks.select("*", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))).alias("conv"))
    keyed = written(keyed.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text")), "chat-keyed")  # keys of null conversations stand once written
    bucket = F.struct(F.coalesce(F.floor(F.col("turn") / 4096), F.lit(-(1 << 62))).alias("a"), F.when(F.col("turn").isNull(), F.shiftright("h", 52)).otherwise(0).alias("b"))
    found = Runs("conv", "bucket", ["turn", "h", "text"]).numbered(keyed.withColumn("bucket", bucket), "n")
    return written(found.drop("bucket", "h"), "chat-blocks")


def _counts(frames):
    """Feature counts by state, and transitions inside a block; transitions between blocks come apart."""
    for frame in frames:
        seen: dict[tuple, int] = {}
        for text, role in zip(frame["text"], frame["role"], strict=True):
            if role not in ROLES:
                continue
            for i, (_, line, blanks) in enumerate(observed(text)):
                state = 2 * ROLES.index(role) + (i > 0)
                for k, value in enumerate(features(line, blanks > 0)):
                    seen[k, state, value] = seen.get((k, state, value), 0) + 1
                if i:
                    seen[-1, state - (i == 1), state] = seen.get((-1, state - (i == 1), state), 0) + 1
        rows = [(k, a, b, n) for (k, a, b), n in seen.items()]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "n"])


def fit(blocks: DataFrame, training: Column) -> TurnModel:
    """Smoothed counts over the blocks where `training` holds; `blocks` as `ordered` gives them, or raw."""
    ship(blocks.sparkSession)
    blocks = blocks if "n" in blocks.columns else ordered(blocks)
    rows = blocks.filter(training & F.col("role").isin(*ROLES)).select("conv", "n", "text", "role")
    inside = rows.select("text", "role").mapInPandas(_counts, "kind int, a int, b int, n long")
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S")))
    ends = rows.select("conv", "n", (2 * number).alias("first"), (2 * number + F.when(lines > 1, 1).otherwise(0)).alias("last"), lines.alias("lines")).filter("lines > 0")
    later = ends.select("conv", (F.col("n") - 1).alias("n"), F.col("first").alias("next"))
    between = ends.join(later, ["conv", "n"]).select(F.lit(-1).alias("kind"), F.col("last").alias("a"), F.col("next").alias("b"), F.lit(1).cast("long").alias("n"))
    begins = ends.filter("n = 0").select(F.lit(-1).alias("kind"), F.lit(START).alias("a"), F.col("first").alias("b"), F.lit(1).cast("long").alias("n"))
    totals = inside.unionByName(between).unionByName(begins).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred rows
    move = np.full((START + 1, START + 1), 0.1)
    emit = [np.full((STATES, size), 0.5) for size in FEATURES]
    for r in totals:
        (move if r["kind"] == -1 else emit[r["kind"]])[r["a"], r["b"]] += r["n"]
    move[:, START] = 0
    for role in range(len(ROLES)):  # a further line only follows a line of its own turn
        for state in range(START + 1):
            if state // 2 != role or state == START:
                move[state, 2 * role + 1] = 0
    with np.errstate(divide="ignore"):
        return TurnModel(np.log(move / move.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


@dataclass
class Segments:
    """The segments of a task: their keys, and their lines one after the other."""

    keys: list[tuple]  # conv, conv_id, seg
    lengths: np.ndarray
    table: np.ndarray
    lines: list[tuple]  # turn, number in the block, text, blank lines before


def _segments(frame: pd.DataFrame) -> Segments:
    frame = frame.sort_values(["conv", "n"], kind="stable")
    keys, counts, lines = [], [], []
    none = object()
    last = (none, none)
    columns = (frame[c].tolist() for c in ("conv", "conv_id", "seg", "turn", "text"))
    for conv, conv_id, seg, turn, text in zip(*columns, strict=True):
        if (conv, seg) != last:
            last = (conv, seg)
            keys.append((conv, conv_id, seg))
            counts.append(0)
        found = observed(text)
        counts[-1] += len(found)
        lines += [(turn, i, line, blanks) for i, line, blanks in found]
    table = np.array([features(line, blanks > 0) for _, _, line, blanks in lines], dtype=int).reshape(-1, len(FEATURES))
    return Segments(keys, np.array(counts, dtype=np.int64), table, lines)


def _segment_matrices(frame: pd.DataFrame, model: TurnModel) -> pd.DataFrame:
    found = _segments(frame)
    matrices = model.matrices(found.table, found.lengths)
    return pd.DataFrame([(conv, seg, m.ravel()) for (conv, _, seg), m in zip(found.keys, matrices, strict=True)], columns=["conv", "seg", "matrix"])


def _product(key, frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for flat in frame.sort_values("seg")["matrix"]:
        one = np.array(flat).reshape(START + 1, START + 1)
        total = one if total is None else times(total, one)
    return pd.DataFrame([(key[0], key[1], total.ravel())], columns=["conv", "seg", "matrix"])


def _top(key, frame: pd.DataFrame) -> pd.DataFrame:
    """The best end of a whole conversation."""
    matrix = np.array(frame["matrix"].iloc[0]).reshape(START + 1, START + 1)
    entry = opening()
    return pd.DataFrame([(key[0], 0, entry, int((entry[:, None] + matrix).max(axis=0).argmax()))], columns=["conv", "seg", "entry", "exit_state"])


def _hand_down(key, children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    children = children.sort_values("seg")
    matrices = [np.array(m).reshape(START + 1, START + 1) for m in children["matrix"]]
    entry = [np.array(parent["entry"].iloc[0], dtype=float)]
    for m in matrices:
        entry.append((entry[-1][:, None] + m).max(axis=0))
    state = int(parent["exit_state"].iloc[0])
    exits = []
    for k in range(len(matrices) - 1, -1, -1):
        exits.append(state)
        state = int((entry[k] + matrices[k][:, state]).argmax())
    rows = [(key[0], seg, e, x) for seg, e, x in zip(children["seg"], entry[:-1], exits[::-1], strict=True)]
    return pd.DataFrame(rows, columns=["conv", "seg", "entry", "exit_state"])


_MATRIX = "conv string, seg long, matrix array<double>"
_ENTRY = "conv string, seg long, entry array<double>, exit_state int"
_PIECES = "conv string, conv_id long, seg long, at int, open boolean, turn long, line int, role string, n_lines long, text string"


def _decode_segments(frame: pd.DataFrame, given: pd.DataFrame, model: TurnModel) -> pd.DataFrame:
    """Turns and parts of turns of each segment; `open` marks the rest of a turn that began before."""
    found = _segments(frame)
    entry, exits = np.tile(opening(), (len(found.keys), 1)), np.full(len(found.keys), -1)
    known = {(conv, seg): (e, x) for conv, seg, e, x in zip(given["conv"], given["seg"], given["entry"], given["exit_state"], strict=True)}
    for i, (conv, _, seg) in enumerate(found.keys):
        if (conv, seg) in known:
            entry[i], exits[i] = known[conv, seg]
    path = model.decode(found.table, found.lengths, entry, exits).tolist()
    rows, k = [], 0
    for (conv, conv_id, seg), n in zip(found.keys, found.lengths.tolist(), strict=True):
        turns: list[tuple] = []
        for i in range(n):
            (turn, number, line, blanks), state = found.lines[k], path[k]
            k += 1
            first = state % 2 == 0
            if first or not turns:
                turns.append((not first, turn, number, ROLES[state // 2], []))
            elif not turns[-1][4] or turns[-1][4] == [""]:
                blanks = 0  # the marker stood on a line of its own
            turns[-1][4].extend([""] * (0 if first else blanks))
            turns[-1][4].append(without_marker(line) if first else line)
        for at, (more, turn, number, role, ls) in enumerate(turns):
            rows.append((conv, conv_id, seg, at, more, turn, number, role, sum(1 for x in ls if x), "\n".join(ls)))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])
    return out.astype({"conv_id": "Int64", "turn": "Int64"})


def _whole_turns(pieces: DataFrame, fan: int) -> DataFrame:
    """Parts of turns joined to the last turn that began before their segment."""
    group = F.floor(F.col("seg") / fan)
    begun = pieces.groupBy("conv", "seg").agg(F.max(F.when(~F.col("open"), F.col("seg"))).alias("begun"), F.max("at").alias("last")).withColumn("g", group)
    before = Window.partitionBy("conv").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = begun.groupBy("conv", "g").agg(F.max("begun").alias("begun")).select("conv", "g", F.max("begun").over(before).alias("base"))
    inside = Window.partitionBy("conv", "g").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    owner = begun.join(groups, ["conv", "g"]).select("conv", "seg", F.coalesce(F.max("begun").over(inside), F.col("base")).alias("owner"))
    opened = pieces.filter("open").join(owner, ["conv", "seg"])
    lasts = opened.select("conv", F.col("owner").alias("seg")).distinct().join(begun.select("conv", "seg", F.col("last").alias("at")), ["conv", "seg"])
    starts = pieces.join(lasts, ["conv", "seg", "at"], "left_semi").withColumn("owner", F.col("seg"))
    joined = starts.unionByName(opened).groupBy("conv", "owner").agg(
        *[F.min_by(c, "seg").alias(c) for c in ("conv_id", "turn", "line", "role")], F.sum("n_lines").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    whole = pieces.filter("not open").join(lasts, ["conv", "seg", "at"], "left_anti")
    kept = ["conv_id", "turn", "line", "role", "n_lines", "text"]
    return whole.select(*kept).unionByName(joined.select(*kept))


def parse_transcripts(blocks: DataFrame, model: TurnModel, span: int = 1024, fan: int = 256, group_bytes: int = 8_000_000) -> DataFrame:
    """One row for each recovered turn: where it starts, its role, n_lines that are not blank, bare text and canonical rendering.

    `blocks` as `ordered` gives them, or raw; their roles are not read.
    """
    spark = blocks.sparkSession
    ship(spark)
    blocks = blocks if "n" in blocks.columns else ordered(blocks)
    size = blocks.agg(F.max("n").alias("last"), F.sum(F.octet_length("text")).alias("bytes")).first()
    packs = max(shuffle_partitions(spark), -(-(size["bytes"] or 0) // group_bytes))
    pack = F.pmod(F.xxhash64("conv", "seg"), F.lit(packs)).alias("pack")
    rows = blocks.withColumn("seg", F.floor(F.col("n") / span)).select("conv", "conv_id", "n", "seg", "turn", "text").select("*", pack)
    several = size["last"] is not None and size["last"] >= span  # some conversation has more than one segment
    given = spark.createDataFrame([], _ENTRY)
    if several:
        longer = rows.filter(F.col("n") == span).select("conv")
        cut = rows.filter("seg > 0").unionByName(rows.filter("seg = 0").join(longer, "conv", "left_semi").select(*rows.columns))
        levels = [written(cut.groupBy("pack").applyInPandas(lambda frame: _segment_matrices(frame, model), _MATRIX), "chat-level")]
        top = size["last"] // span
        while top:
            top //= fan
            parents = levels[-1].withColumn("g", F.floor(F.col("seg") / fan)).groupBy("conv", "g").applyInPandas(_product, _MATRIX)
            levels.append(written(parents, "chat-level"))
        given = levels.pop().groupBy("conv").applyInPandas(_top, _ENTRY)
        while levels:
            children = levels.pop().withColumn("g", F.floor(F.col("seg") / fan))
            given = children.groupBy("conv", "g").cogroup(given.withColumn("g", F.col("seg")).groupBy("conv", "g")).applyInPandas(_hand_down, _ENTRY)
    given = given.select("*", pack)
    pieces = rows.groupBy("pack").cogroup(given.groupBy("pack")).applyInPandas(lambda frame, given: _decode_segments(frame, given, model), _PIECES)
    turns = _whole_turns(written(pieces, "chat-pieces"), fan) if several else pieces
    text = F.regexp_replace("text", r"^\n+", "")
    return turns.select("conv_id", "turn", "line", "role", "n_lines", text.alias("text"), rendered(F.col("role"), text).alias("rendered"))


def rendered(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))
