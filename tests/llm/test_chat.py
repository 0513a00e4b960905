"""Transcript parsing: Viterbi by brute force, held-out accuracy, edge cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from ferret.llm import chat

SF = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    states = ["a/first", "a/next", "b/first"]
    lines = ["User: hi?", "", "some text.", "Bot: yes", "  more"]
    seen = {x for k, line in enumerate(lines) for x in chat.features(line, lines[k - 1] if k else None)}
    m = chat.Model(states, rng.normal(size=3), rng.normal(size=(3, 3)), {x: rng.normal(size=3) for x in sorted(seen)})
    def value(path):
        v = m.start[path[0]] + sum(m.move[a, b] for a, b in zip(path, path[1:]))
        return v + sum(m.emit[x][s] for k, s in enumerate(path) for x in chat.features(lines[k], lines[k - 1] if k else None))
    best = max(itertools.product(range(3), repeat=len(lines)), key=value)
    assert chat.viterbi(m, lines) == [states[k] for k in best]


def test_held_out_conversations(spark):
    got = chat.op9_chat(spark, SF)
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert got.count() == n
    right = got.where("held_out").agg(F.avg(F.col("roles_right").cast("double"))).first()[0]
    assert right > 0.8, right


def test_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello\nthere"), (1, 1, "assistant", "hello\nthere"), (2, 0, None, None),
            (None, 0, "user", "x"), (3, 0, "user", "y" * 300_000), (4, None, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    made = chat.transcripts(df)
    assert made.count() == 5
    model = chat.fit(made)
    out = {r.id: r for r in chat.parse(made, model).collect()}
    assert len(out) == 5 and out[3].rendered.startswith(chat.START) and len(out[3].rendered) > 300_000
    none = chat.fit(made.limit(0))
    texts = spark.createDataFrame([(1, None), (2, " \n "), (3, "a: b\nc")], "id long, text string")
    got = {r.id: r for r in chat.parse(texts, none).collect()}
    assert got[1].rendered == got[2].rendered == "" and got[3].roles == ["user"]
    assert chat.parse(texts.limit(0), model).count() == 0


def test_render():
    lines = "System: be kind\nUser: hello\nhow are you?\nAssistant: fine"
    states = ["system/first", "user/first", "user/next", "assistant/first"]
    m = chat.Model(sorted(set(states)), np.zeros(4), np.zeros((4, 4)), {}, {}, frozenset({"system", "user", "assistant"}))
    at = {s: k for k, s in enumerate(m.states)}
    for line, s in zip(lines.split("\n"), states):
        v = m.emit.setdefault(chat.features(line, None)[0], np.full(4, -9.0))
        v[at[s]] = 0
    assert chat.render(chat.turns(m, lines)) == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhello\nhow are you?<|im_end|>\n"
                                                 "<|im_start|>assistant\nfine<|im_end|>\n")
