"""Secret scan with a random forest that removes false positives.

Native DataFrame operations and Spark's own forest only.  A pattern finds
candidate strings; each gets features of its length, its character transitions,
the share covered by dictionary words, the path it stands in and its
neighbouring words.  The forest learns from labelled findings which candidates
are secrets.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferret.llm.common import class_sample, crc_mod, shipped, stored, table, text_or_empty

# A candidate: 16 characters of a key alphabet or more, with a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
CONTEXT = 60
# Uses in the corpus from which a run of letters counts as a dictionary word.
DICTIONARY_USES = 20
# The forest is fitted on about this many labelled findings of each class.
SAMPLE_PER_CLASS = 10_000
TREES, DEPTH, SEED = 20, 6, 5
THRESHOLD = 0.5
MASK = "[SECRET]"
FEATURES = ["length", "digits", "uppers", "transitions", "dictionary", "slashes", "in_path", "before_odds", "after_odds", "sign"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, start, candidate, before, after) of every candidate of every whole text; ``h`` is the text's hash.

    Equal rows give equal findings once.
    """
    text = F.col("text")
    some = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).where(text.rlike(CANDIDATE))
    some = some.select("doc_id", F.xxhash64("text").alias("h"), F.split(text, CANDIDATE, -1).alias("seg"),
                       F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"))
    flat = some.select("doc_id", "h", F.posexplode(F.arrays_zip(
        "c", F.slice("seg", F.lit(1), F.size("c")).alias("seg"), F.slice("seg", F.lit(2), F.size("c")).alias("next"))).alias("k", "z"))
    flat = flat.select("doc_id", "h", "k", F.col("z.c").alias("candidate"), F.col("z.seg").alias("seg"), F.col("z.next").alias("next")).distinct()
    so_far = Window.partitionBy("doc_id", "h").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("seg") + F.length("candidate")).over(so_far)
    return flat.select("doc_id", "h", (end - F.length("candidate")).cast("long").alias("start"), "candidate",
                       F.substring("seg", -CONTEXT, CONTEXT).alias("before"), F.substring("next", 1, CONTEXT).alias("after"))


def neighbours(found: DataFrame) -> DataFrame:
    """Adds the word before and after, and whether a sign of assignment stands between."""
    return (found.withColumn("word_before", F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1)))
            .withColumn("word_after", F.lower(F.regexp_extract("after", r"^[^\p{L}]*(\p{L}+)", 1)))
            .withColumn("sign", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double")))


def dictionary(docs: DataFrame, runs: DataFrame, text_col: str = "text") -> DataFrame:
    """(run, uses) of those runs of letters that the corpus uses as words often enough."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}]+")).alias("run"))
    return words.join(shipped(runs), "run").groupBy("run").count().where(F.col("count") >= DICTIONARY_USES).select("run")


def _count(c: str, pattern: str) -> Column:
    return F.regexp_count(F.col(c), F.lit(pattern)).cast("double")


def featured(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the numeric features that need no labels."""
    key = ["doc_id", "h", "start"]
    runs = found.select(*key, F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("run"))
    runs = stored(runs, "secrets-runs")
    known = stored(dictionary(docs, stored(runs.select("run").distinct(), "secrets-run"), text_col), "secrets-words")
    covered = runs.join(known, "run").groupBy(*key).agg(F.sum(F.length("run")).alias("covered"))
    same = F.expr("f.h = c.h and f.start = c.start and f.doc_id <=> c.doc_id")
    x = neighbours(found).alias("f").join(covered.alias("c"), same, "left").select("f.*", "c.covered")
    n = F.length("candidate").cast("double")
    edge = r"(?<=[0-9])(?![0-9])|(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])"
    return x.select("*", n.alias("length"), (_count("candidate", "[0-9]") / n).alias("digits"), (_count("candidate", "[A-Z]") / n).alias("uppers"),
                    (_count("candidate", edge) / n).alias("transitions"), (F.coalesce("covered", F.lit(0)) / n).alias("dictionary"),
                    (_count("candidate", "/") / n).alias("slashes"),
                    (F.col("before").rlike(r"(://|www\.|/)\S*$") | F.col("after").rlike(r"^[./]\w")).cast("double").alias("in_path"))


def _odds(labelled: DataFrame, word: str, name: str) -> DataFrame:
    """(word, log odds of a secret beside it), smoothed; learnt from the labelled findings."""
    p, n = F.sum("label"), F.count("*")
    return labelled.groupBy(word).agg(F.log((p + 1.0) / (n - p + 1.0)).alias(name))


class Forest:
    """A fitted scan: forest, odds of the neighbouring words, or one class when the labels hold only one."""

    def __init__(self, model: PipelineModel | None, before: DataFrame, after: DataFrame, only: float):
        self.model, self.before, self.after, self.only = model, before, after, only

    def _join(self, x: DataFrame) -> DataFrame:
        x = x.join(self.before, "word_before", "left").join(self.after, "word_after", "left")
        return x.fillna(0.0, ["before_odds", "after_odds"])

    def score(self, x: DataFrame) -> DataFrame:
        """Adds ``score``, the forest's probability of a secret."""
        x = self._join(x)
        if self.model is None:
            return x.withColumn("score", F.lit(self.only))
        out = self.model.transform(x)
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(labelled: DataFrame) -> Forest:
    """``labelled``: featured findings with ``label`` 0 or 1; other labels are ignored."""
    labelled = labelled.where("label in (0, 1)").withColumn("label", F.col("label").cast("double"))
    before = stored(_odds(labelled, "word_before", "before_odds").coalesce(1), "secrets-before")
    after = stored(_odds(labelled, "word_after", "after_odds").coalesce(1), "secrets-after")
    forest = Forest(None, before, after, 0.0)
    classes = [r.label for r in labelled.select("label").distinct().collect()]
    if len(classes) < 2:
        forest.only = classes[0] if classes else 0.0
        return forest
    rows = stored(class_sample(forest._join(labelled).withColumn("y", F.col("label").cast("int")), "y", ["doc_id", "h", "start"], SAMPLE_PER_CLASS),
                  "secrets-train")
    forest.model = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")]).fit(rows)
    return forest


def certain(found: DataFrame) -> DataFrame:
    """Labels (1, 0 or null) of findings whose form or place is certain.

    Secret: an issuer's fixed form, or a value given to a name of a credential.
    Not a secret: a number alone, or a part of an address.  The tables hold no
    labelled findings, so the queries learn from these; a user passes their own.
    """
    c, b = F.col("candidate"), F.lower("before")
    yes = c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | c.rlike("^gh[pousr]_[0-9A-Za-z]{36}$") | b.rlike(
        r"(passwd|password|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?$")
    no = c.rlike("^[0-9-]+$") | b.rlike(r"://\S*$")
    return found.withColumn("label", F.when(yes, 1).when(no, 0).cast("int"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings (doc_id, h, start, candidate, score, is_secret, ...) of every whole text.

    ``labelled`` (doc_id, h, start, label) overrides the certain labels.  Null
    and empty texts hold nothing; null ids are kept; an empty table and one
    without labelled findings give no secret.
    """
    x = stored(featured(stored(candidates(docs, id_col, text_col), "secrets-found"), docs, text_col), "secrets-features")
    own = certain(x) if labelled is None else x.alias("x").join(labelled.alias("l"), F.expr(
        "x.h = l.h and x.start = l.start and x.doc_id <=> l.doc_id")).select("x.*", "l.label")
    out = fit(own.where(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(True)))).score(x)
    return out.withColumn("is_secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; each secret of a text is replaced by a mask."""
    bad = (findings.where("is_secret").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "candidate")
           .groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.struct(F.length("candidate").alias("n"), "candidate")), False).alias("_bad")))
    x = docs.withColumn("_text_h", F.xxhash64(text_or_empty(text_col)))
    x = x.join(shipped(stored(bad, "secrets-bad")), F.expr(f"_text_h = _h and `{id_col}` <=> _id"), "left")
    clean = F.aggregate(F.col("_bad.candidate"), F.col(text_col), lambda t, c: F.replace(t, c, F.lit(MASK)))
    return x.withColumn(text_col, F.when(F.col("_bad").isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents; the candidate itself leaves as a digest."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                      F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")
