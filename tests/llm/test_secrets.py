"""Secret scan: candidates and offsets by brute force, decisions, redaction, edge cases."""

import re

from pyspark.sql import functions as F

from ferret.llm import secrets

SF = "/root/testdata/sf0.1"
AKIA = "AKIA" + "Q2Z7" * 4


def test_candidates_and_offsets(spark):
    texts = ["x " + AKIA + " y " + AKIA, AKIA, "a=" + "ab12" * 5 + "== 1234567890123456", "", None, "no digits abcdefghijklmnopqrstuvwx", "é" * 5 + " " + "0" * 40_000,
             "café 9999888877776666/é"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, AKIA), (None, AKIA)], "doc_id long, text string").withColumn("start", F.lit(1))
    got = sorted((r.doc_id, r.start, r.candidate) for r in secrets.candidates(df).where("doc_id is not null").collect())
    want = sorted((i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(secrets.CANDIDATE, t or ""))
    assert got == want
    assert secrets.candidates(df).where("doc_id is null").count() == 1


def test_table(spark):
    got = secrets.op2_secrets(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    planted = {(d.doc_id, m.start(2)) for d in docs for m in re.finditer(r"()(AKIA[0-9A-Z]{16})|(?:password=|token = \")([0-9a-f]{16,})", d.text or "") if m[2]}
    planted |= {(d.doc_id, m.start(1)) for d in docs for m in re.finditer(r"(?:password=|token = \")([0-9a-f]{16,})", d.text or "")}
    rows = {(r.doc_id, r.start): r for r in got.collect()}
    assert planted and planted <= {k for k, r in rows.items() if r.is_secret}
    numbers = {(d.doc_id, m.start()) for d in docs for m in re.finditer(r"(?<![\w+/-])\d{16}(?![\w+/=-])", d.text or "")}
    assert not any(rows[k].is_secret for k in numbers if k in rows)


def test_redact_and_edges(spark):
    rows = [(k, f"word password={k:04d}abcd0123ef567890 more") for k in range(40)] + [(k, f"order {k:04d}567812345678 shipped") for k in range(40, 80)]
    rows += [(100, None), (101, ""), (None, "token: " + "9f" * 12), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("candidate", F.lit("x")).withColumn("h", F.lit(5))
    found = secrets.scan(df)
    out = secrets.redact(df, found)
    assert out.columns == df.columns and out.count() == df.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[3] == "word password=[SECRET] more" and by[50] == rows[50][1] and by[100] is None and by[101] == ""
    assert by[None] == "token: [SECRET]"
    assert secrets.redact(df.limit(0), secrets.scan(df.limit(0))).count() == 0
    plain = df.where("doc_id >= 100")
    assert secrets.redact(plain, secrets.scan(plain)).count() == 2


def test_many_findings_at_one_offset(spark):
    # offsets at which the hash of the offset alone would take every one, or none, of 20,000 findings
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    out, taken = ([r.id for r in spark.range(9, 60).where(c).orderBy("id").limit(1).collect()][0] for c in (draw >= 0.5, draw < 0.5))
    for at in (out, taken):
        yes = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(
            F.lit("password=".rjust(at)), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20), F.lit("7")).alias("text"))
        no = spark.range(50_000, 50_400).select(F.col("id").alias("doc_id"), F.concat(
            F.repeat(F.lit("x "), (F.col("id") % 40).cast("int")), F.lit("order "), (F.col("id") + F.lit(10 ** 15)).cast("string")).alias("text"))
        found = secrets.scan(yes.unionByName(no))
        row = found.groupBy().agg(F.count(F.when(F.col("doc_id") < 20_000, 1)).alias("n"),
                                  F.avg(F.when(F.col("doc_id") < 20_000, F.col("is_secret").cast("int"))).alias("yes"),
                                  F.avg(F.when(F.col("doc_id") >= 20_000, F.col("is_secret").cast("int"))).alias("no")).first()
        assert row.n >= 19_990 and row.yes > 0.99 and row.no < 0.01, (at, row)
    labelled = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").alias("h"), F.lit(taken).alias("start"), F.lit(1).alias("y"))
    assert 9_000 < secrets.class_sample(labelled, "y", ["doc_id", "h", "start"], secrets.SAMPLE_PER_CLASS).count() < 11_000
