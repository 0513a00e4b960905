"""The pipeline against a brute-force version of each stage, and its edge cases."""

import os
import sys

from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline as P  # noqa: E402
import test_decontam as D  # noqa: E402
import test_jaccard as J  # noqa: E402
from ferret.llm import bpe, quality, secrets  # noqa: E402
from ferret.llm.common import stored  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    sizes = quality.Sizes(model.good, model.bad)
    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{k}")
        out.append(docs)
        assert k == 4 or docs.columns == columns
    got = [{r.doc_id: r.text for r in x.collect()} for x in out[:4]]
    cut = quality.np.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    want = {d: t for d, t in rows.items() if model.slope * sizes(t) + model.offset >= cut}
    assert got[0] == want
    comp = J.brute(list(want.items()))
    want = {d: want[d] for d, _, c in comp if d == c}
    assert got[1] == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in (D.words(t) for _, t in items) for i in range(max(1, len(w) - 9)) if w}
    def leaks(t):
        w = D.words(t)
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))
    assert min(map(len, windows)) == 10
    want = {d: t for d, t in want.items() if not leaks(t)}
    assert got[2] == want
    bad = {}
    for r in secrets.scan(out[2]).where("is_secret").collect():
        bad.setdefault(r.doc_id, set()).add(r.candidate)
    assert bad
    for d, cs in bad.items():
        for c in sorted(cs, key=lambda c: (-len(c), c)):
            want[d] = want[d].replace(c, secrets.MASK)
    assert got[3] == want
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    last = out[4].collect()
    assert len(last) == len(want)
    for r in last:
        ids = tok.encode(want[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (None, "plain words " * 30, "en", "s", 1),
                                  (3, "same text " * 40, "en", "s", 1), (3, "same text " * 40, "en", "s", 1), (4, "Same text " * 40, "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    for t, x in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")),
                 ("benchmark", spark.createDataFrame([(1, None), (None, "plain words")], "item_id long, text string"))):
        x.write.parquet(f"{tmp_path}/{t}.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "None"]
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        empty = stored(stage(spark, empty, str(tmp_path)), f"empty-{k}")
        assert empty.count() == 0
