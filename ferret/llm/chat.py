"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

The hidden state of a line is (role, first line of a turn or not).  What is
seen of a line are its speaker marker and a few features of its form.  Starts,
transitions and emissions are counted in Spark from labelled lines; Viterbi
recovers the likeliest states, and every turn is rendered the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import INT, LONG, STR, byte_batches, crc_mod, schema, stored, table, text_or_empty

# A speaker marker: a short name in one of the usual forms at the start of a line.
MARKER = regex.compile(r"^\s*(?:[#*>\-]+\s*)?[<\[(*]{0,2}\s*(\p{L}{1,20})\s*[>\])*]{0,2}\s*(?::|\||>|$)\s*[*]{0,2}\s*")
SMOOTHING = 0.5
START, END = "<|im_start|>", "<|im_end|>"


def features(line: str, before: str | None) -> list[str]:
    """Independent observations of a line, given the line before it."""
    m = MARKER.match(line)
    body = line[m.end():] if m else line
    # a whole line that is one word is a marker only if nothing else stands on it
    name = m.group(1).lower() if m and (line[:m.end()].rstrip()[-1:] in ":|>])*" or not body) else ""
    size = len(line.strip())
    return [f"m={name}", f"l={min(6, size.bit_length() // 2)}", f"p={'none' if before is None else 'blank' if not before.strip() else 'text'}",
            f"e={line.rstrip()[-1:] if line.rstrip()[-1:] in '?!.:' else ''}", f"i={line[:1].isspace()}", f"b={not line.strip()}"]


def strip_marker(line: str, markers: frozenset) -> str:
    m = MARKER.match(line)
    return line[m.end():] if m and m.group(1).lower() in markers else line


@dataclass
class Model:
    """Log-probabilities; ``markers`` are the names that open a turn in the labelled lines."""

    states: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]
    unseen: dict[str, np.ndarray] = field(default_factory=dict)
    markers: frozenset = frozenset()


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (kind, a, b) over labelled transcripts: states of successive lines and their features."""
    for batch in batches:
        seen: dict[tuple[str, str, str], int] = {}
        for text, states in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines, last = text.split("\n"), None
            for k, (line, s) in enumerate(zip(lines, states)):
                todo = [("s", s, "") if last is None else ("t", last, s)]
                todo += [("e", s, x) for x in features(line, lines[k - 1] if k else None)]
                for x in todo:
                    seen[x] = seen.get(x, 0) + 1
                last = s
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(3)] + [
            pa.array(list(seen.values()), pa.int64())], names=["kind", "a", "b", "n"])


def fit(labelled: DataFrame, text_col: str = "text", states_col: str = "states") -> Model:
    """Model from transcripts whose lines carry states such as ``user/first`` and ``user/next``.

    Only counts per state, feature and pair of states reach the driver; names
    of markers that appear once in the labelled lines are dropped.
    """
    byte_batches(labelled.sparkSession)
    counts = (labelled.where(F.col(text_col).isNotNull() & F.col(states_col).isNotNull()).select(text_col, states_col)
              .mapInArrow(_observe, schema(kind=STR, a=STR, b=STR, n=LONG)).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    rows = counts.where("kind <> 'e' or n > 1").collect()
    states = sorted({r.a for r in rows} | {r.b for r in rows if r.kind == "t"})
    at = {s: k for k, s in enumerate(states)}
    n = len(states)
    start, move = np.full(n, SMOOTHING), np.full((n, n), SMOOTHING)
    emit: dict[str, np.ndarray] = {}
    for r in rows:
        if r.kind == "s":
            start[at[r.a]] += r.n
        elif r.kind == "t":
            move[at[r.a], at[r.b]] += r.n
        else:
            emit.setdefault(r.b, np.full(n, SMOOTHING))[at[r.a]] += r.n
    total: dict[str, np.ndarray] = {}
    for x, v in emit.items():
        total[x[:2]] = total.get(x[:2], np.full(n, SMOOTHING)) + v
    firsts = np.array([s.endswith("/first") for s in states], bool)
    markers = frozenset(x[2:] for x, v in emit.items() if x.startswith("m=") and len(x) > 2 and n and v[firsts].sum() > v[~firsts].sum())
    return Model(states, np.log(start / start.sum()) if n else start, np.log(move / move.sum(1, keepdims=True)) if n else move,
                 {x: np.log(v / total[x[:2]]) for x, v in emit.items()}, {k: np.log(SMOOTHING / v) for k, v in total.items()}, markers)


def viterbi(model: Model, lines: list[str]) -> list[str]:
    """The likeliest states of the lines; ties go to the first state by name."""
    if not lines or not model.states:
        return [""] * len(lines)
    back, score = [], None
    for k, line in enumerate(lines):
        own = sum(model.emit.get(x, model.unseen.get(x[:2], 0.0)) for x in features(line, lines[k - 1] if k else None))
        if score is None:
            score = model.start + own
        else:
            step = score[:, None] + model.move
            back.append(step.argmax(0))
            score = step.max(0) + own
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [model.states[k] for k in reversed(path)]


def turns(model: Model, text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn: a line in a first state, or of another role, opens one."""
    out: list[tuple[str, list[str]]] = []
    lines = text.split("\n") if text.strip() else []
    for line, state in zip(lines, viterbi(model, lines)):
        role, _, place = (state or "user/next").partition("/")
        if not out or place == "first" or out[-1][0] != role:
            out.append((role, [strip_marker(line, model.markers)]))
        else:
            out[-1][1].append(line)
    return [(r, "\n".join(x).strip()) for r, x in out]


def render(parts: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{r}\n{x}{END}\n" for r, x in parts)


def _parse(model_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model_of.value
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        got = [turns(model, t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            ids, pa.array([[r for r, _ in g] for g in got], pa.list_(pa.string())), pa.array([[x for _, x in g] for g in got], pa.list_(pa.string())),
            pa.array([render(g) for g in got], pa.string())], names=["id", "roles", "texts", "rendered"])


def parse(transcripts: DataFrame, model: Model, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, roles, texts, rendered) of every transcript.

    A null, empty or blank transcript has no turns and renders as the empty
    text; without labelled lines the whole transcript is one turn of ``user``.
    """
    spark = transcripts.sparkSession
    byte_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    many = T.ArrayType(STR)
    return transcripts.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(
        partial(_parse, shared), T.StructType([T.StructField("id", transcripts.schema[id_col].dataType), T.StructField("roles", many),
                                               T.StructField("texts", many), T.StructField("rendered", STR)]))


# Ways in which the transcripts of the query mark a speaker; the last leaves a
# blank line between turns and no name.
STYLES = ("{}: ", "### {}\n", "<{}> ", "[{}]: ", "**{}:** ", "")
NAMES = {"user": "Human", "assistant": "Bot", "system": "Instructions"}


def transcripts(conversations: DataFrame) -> DataFrame:
    """(id, text, states): each conversation written as one text in a style that its id chooses.

    Repeated turns follow each other in the order of role and text; null roles
    count as ``user`` and null texts as empty.
    """
    role = F.coalesce("role", F.lit("user"))
    other = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in NAMES.items()], role)
    pick = lambda n, seed: F.pmod(F.xxhash64("conv_id", F.lit(seed)), F.lit(n))
    name = F.when(pick(2, 1) == 0, F.initcap(role)).otherwise(other)
    style = pick(len(STYLES), 2)
    prefix = F.lit("")
    for k, s in enumerate(STYLES):
        if s:
            a, b = s.split("{}")
            prefix = F.when(style == k, F.concat(F.lit(a), name, F.lit(b))).otherwise(prefix)
    body = F.concat(prefix, F.coalesce("text", F.lit("")), F.when(style == len(STYLES) - 1, F.lit("\n")).otherwise(F.lit("")))
    lines = F.size(F.split(body, "\n"))
    state = F.concat(F.array(F.concat(role, F.lit("/first"))), F.array_repeat(F.concat(role, F.lit("/next")), lines - 1))
    one = conversations.select("conv_id", F.struct("turn", role.alias("r"), body.alias("t"), state.alias("s")).alias("x"))
    return (one.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
            .select(F.col("conv_id").alias("id"), F.array_join("xs.t", "\n").alias("text"), F.flatten("xs.s").alias("states"),
                    F.col("xs.r").alias("true_roles")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; models learn from those with crc32(conv_id) mod 4 > 0 only."""
    made = stored(transcripts(table(spark, sf_dir, "conversations")), "chat-transcripts")
    held = F.coalesce(crc_mod("id", 4) == 0, F.lit(False))
    out = parse(made, fit(made.where(~held)))
    return (out.join(made.select(F.col("id").alias("of"), "true_roles"), F.col("id").eqNullSafe(F.col("of")))
            .select(F.col("id").alias("conv_id"), held.alias("held_out"), F.size("roles").cast("long").alias("n_turns"),
                    F.array_join("roles", ",").alias("roles"), (F.col("roles") == F.col("true_roles")).alias("roles_right"),
                    F.sha2("rendered", 256).alias("rendered_sha256"), "rendered"))
