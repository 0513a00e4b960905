"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re

import duckdb

from ferret.llm import turns

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows):
    """Cheapest (cost, audit, repaired turns) by best-first search over all edit sequences."""
    fault = faults(rows)
    heap, best = [(0, "", 0, (), "")], None
    while heap:
        cost, audit, i, out, roles = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            return best
        if i == len(rows) and GOOD.match(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        # no longer prefix of a good answer
        if not re.match(r"s?(ua)*u?\Z", roles):
            continue
        for c, name in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, f"{name}:"), roles + c))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out, roles))
            if fault[i] not in ("blank", "duplicate"):
                more = cost + 3 * (fault[i] == "truncated")
                if role:
                    heapq.heappush(heap, (more, audit + "K", i + 1, (*out, f"{role}:{text}"), roles + role[0]))
                for c, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (more + 3, audit + "R", i + 1, (*out, f"{name}:{text}"), roles + c))
    return best


def answer(conv, rows):
    """The query's row for rows (turn, role, text) that are in order."""
    turn = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    cost, audit, out = search(said)
    f = faults(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    return (conv, max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(spark, df):
    found = turns.audits(df)
    sha = {r.conv_id: r.repaired_sha256 for r in turns.digests(df, found).collect()}
    return {r.conv_id: (*r, sha[r.conv_id]) for r in found.collect()}, turns.repair(df, found)


def place(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest())


def test_random_conversations(spark):
    rng = random.Random(2)
    convs = {}
    for c in range(250):
        rows = []
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "])
            rows.append((rng.choice([t, t, t, t + 2, None]), role, rng.choice(["Yes.", "No!", "cut off", "so?  \n", "", " \t", "Yes."])))
        convs[c] = sorted(rows, key=place)
    df = spark.createDataFrame([(c, t, r, x, 1) for c, rows in convs.items() for t, r, x in rows], "conv_id long, turn long, role string, text string, cost int")
    got, texts = repaired(spark, df.repartition(5))
    want = {c: answer(c, rows) for c, rows in convs.items()}
    assert got == want and len({w[7] for w in want.values()}) > 60
    lines = {}
    for r in texts.orderBy("conv_id", "pos").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[8] for c, w in want.items())


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "A."), (7, None, None, "B."), (7, 1, "user", "A."), (7, 1, "user", "A."), (7, 5, "assistant", "C.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, _ = repaired(spark, df)
    filled = lambda c: sorted([(t, r or " ", x or " ") for k, t, r, x in rows if k == c], key=place)
    assert got == {c: answer(c, filled(c)) for c in (None, 7)}
    none = df.limit(0)
    assert turns.audits(none).count() == 0 and turns.repair(none, turns.audits(none)).count() == 0


def test_one_long_conversation(spark):
    """40,000 rows, most of them one repeated row, and a text of 5 MB: as a left-to-right pass over the four states."""
    rng = random.Random(9)
    rows = [(k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice(["", "."])) for k in range(10_000)]
    rows += [(20_000, "user", "again.")] * 30_000 + [(20_001, "assistant", "long " * 1_000_000 + ".")]
    got, _ = repaired(spark, spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string"))
    fault = faults([r[1:] for r in rows])
    now = dict(zip(range(4), [(0, 0), None, (3, 1), (6, 2)]))  # (cost, insertions) by state
    for (_, role, _), f in zip(rows, fault):
        new = {p: None if v is None else (v[0] + 4, v[1]) for p, v in now.items()}
        def put(p, v):
            if v is not None and (new[p] is None or v[0] < new[p][0]):
                new[p] = v
        if f not in ("blank", "duplicate"):
            e = 3 * (f == "truncated")
            for c in "ua":
                for p, r in turns.NEXT[c].items():
                    if now[p] is not None:
                        put(r, (now[p][0] + e + (0 if role[0] == c else 3), now[p][1]))
        for _ in range(3):
            for c in "ua":
                for p, r in turns.NEXT[c].items():
                    if new[p] is not None:
                        put(r, (new[p][0] + 3, new[p][1] + 1))
        now = new
    assert got[1][6] == min(now[0][0], now[3][0]) and got[1][3] == 29_999 and len(got[1][7].replace("I", "")) == len(rows)


def test_table(spark, monkeypatch):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = turns.op13_turns(spark, SF)
    assert got.columns == cols
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(turns.OP13_SQL).fetchall())
