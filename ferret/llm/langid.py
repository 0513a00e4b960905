"""Language identification by unigrams summed over all segmentations.

Every language has probabilities of the pieces of one fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces
(forward algorithm); the pieces' probabilities are learnt by expectation
maximisation over the words of labelled texts.  A text's log-probability is
the sum over its words, so words are scored once per worker and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.llm.common import DBL, INT, LONG, STR, byte_batches, class_sample, crc_mod, schema, stored, table, text_or_empty

# The fit uses a bounded sample: about this many labelled rows of each language.
SAMPLE_PER_LANGUAGE = 2000
ROUNDS = 4
SMOOTHING = 0.01
# Probability of a character that no piece covers, the same in all languages.
UNSEEN = 1e-8
# Distinct words a worker remembers before it starts anew.
CACHE_WORDS = 600_000
UND = "und"
LETTERS = regex.compile(r"\p{L}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """Ordinary pieces of the vocabulary file; U+2581 marks the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size())
                   if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


class Lattice:
    """All pieces inside a list of words, as edges (word, start, end, piece)."""

    def __init__(self, pieces: list[str]):
        self.none = len(pieces)
        # every piece by number, and every beginning of one (-1), so that a start
        # is followed only as far as some piece goes on
        self.id = dict.fromkeys((p[:j] for p in pieces for j in range(1, len(p))), -1)
        self.id.update((p, k) for k, p in enumerate(pieces))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        get, none = self.id.get, self.none
        word, start, end, piece = [], [], [], []
        for k, w in enumerate(words):
            w = "▁" + w
            n = len(w)
            for i in range(n):
                p = get(w[i])
                word.append(k)
                start.append(i)
                end.append(i + 1)
                piece.append(none if p is None or p < 0 else p)
                if p is None:
                    continue
                for j in range(i + 2, n + 1):
                    p = get(w[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        word.append(k)
                        start.append(i)
                        end.append(j)
                        piece.append(p)
        return tuple(np.array(x, np.int64) for x in (word, start, end, piece))


def _steps(at: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    yield from np.split(order, cuts) if len(order) else []


# A longer run of letters is summed part by part, so that products of
# probabilities stay within the range of doubles.
LONGEST_PART = 32


def _parts(words: list[str]) -> dict[int, list[tuple[int, str]]]:
    """(word number, part) by length class, in groups of like size."""
    out: dict[int, list[tuple[int, str]]] = {}
    for k, w in enumerate(words):
        for i in range(0, len(w), LONGEST_PART):
            part = w[i:i + LONGEST_PART]
            out.setdefault(len(part) // 8, []).append((k, part))
    return out


def _alpha(n: int, size: int, frm: np.ndarray, into: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all paths from position 0 of each of ``n`` words (rows of ``size`` positions)."""
    alpha = np.zeros((n * size, p.shape[1]))
    alpha[np.arange(n) * size] = 1
    for e in _steps(at):
        value = alpha[frm[e]] * p[e]
        for lang in range(p.shape[1]):
            alpha[:, lang] += np.bincount(into[e], value[:, lang], minlength=len(alpha))
    return alpha


def forward(lattice: Lattice, words: list[str], probs: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, (words x languages).

    ``probs`` is (pieces + 1) x languages; its last row stands for a character without a piece.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for group in _parts(words).values():
        for a in range(0, len(group), 20_000):
            some = group[a:a + 20_000]
            word, start, end, piece = lattice.edges([w for _, w in some])
            size = int(end.max()) + 1
            alpha = _alpha(len(some), size, word * size + start, word * size + end, end, probs[piece])
            last = alpha[np.arange(len(some)) * size + [len(w) + 1 for _, w in some]]
            np.add.at(out, [k for k, _ in some], np.log(np.maximum(last, 1e-300)))
    return out


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, langs: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language (forward-backward), (pieces + 1) x languages."""
    out = np.zeros_like(probs)
    for group in _parts(words).values():
        for a in range(0, len(group), 20_000):
            some = group[a:a + 20_000]
            of = np.array([k for k, _ in some])
            word, start, end, piece = lattice.edges([w for _, w in some])
            lang = langs[of][word]
            p = probs[piece, lang][:, None]
            size = int(end.max()) + 1
            n = np.array([len(w) + 1 for _, w in some])
            frm, into = word * size + start, word * size + end
            alpha = _alpha(len(some), size, frm, into, end, p)
            # backward: the same sums with positions counted from the end
            back = n[word]
            beta = _alpha(len(some), size, word * size + back - end, word * size + back - start, back - start, p)
            total = np.maximum(alpha[np.arange(len(some)) * size + n, 0], 1e-300)
            uses = alpha[frm, 0] * p[:, 0] * beta[word * size + back - end, 0] / total[word] * counts[of][word]
            np.add.at(out, (piece, lang), uses)
    return out


@dataclass
class Model:
    pieces: list[str]
    langs: list[str]
    probs: np.ndarray


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in LETTERS.findall(text.lower()):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()),
            pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Piece probabilities of every non-null value of ``lang_col``.

    Every round counts expected uses of the pieces over the sampled words in
    Spark; only sums per piece and language reach the driver.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    pieces = vocabulary(path or default_vocabulary())
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    words = stored(class_sample(rows, "lang", "id", per_language).select("lang", "text")
                   .mapInArrow(_words, schema(lang=STR, word=STR, n=LONG))
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    lattice, number = Lattice(pieces), {x: k for k, x in enumerate(langs)}
    probs = np.full((len(pieces) + 1, len(langs)), 1 / max(1, len(pieces)))
    probs[-1] = UNSEEN
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((lattice, number, probs))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lat, num, p = shared.value
            for batch in batches:
                uses = expected(lat, batch.column(1).to_pylist(), np.asarray(batch.column(2), np.float64),
                                np.array([num[x] for x in batch.column(0).to_pylist()], np.int64), p)
                piece, lang = np.nonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()),
                                                  pa.array(uses[piece, lang])], names=["piece", "lang", "uses"])

        sums = (words.mapInArrow(count, schema(piece=INT, lang=INT, uses=DBL)).groupBy("piece", "lang")
                .agg(F.sum("uses").alias("uses")).collect())
        probs = np.full((len(pieces) + 1, len(langs)), SMOOTHING)
        for r in sums:
            probs[r.piece, r.lang] += r.uses
        probs[-1] = 0
        probs /= probs.sum(axis=0)
        probs[-1] = UNSEEN
    return Model(pieces, langs, probs)


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lattice, n = Lattice(model.pieces), len(model.langs)
    known: dict[str, int] = {}
    scores = np.zeros((0, n + 1))
    for batch in batches:
        # words are cut twice, so that only one text's words are held at a time
        texts = [t.lower() for t in batch.column(1).to_pylist()]
        if len(known) > CACHE_WORDS:
            known, scores = {}, np.zeros((0, n + 1))
        fresh = [w for t in texts for w in t.split() if w not in known and known.setdefault(w, len(known)) >= 0]
        runs = [LETTERS.findall(w) for w in fresh]
        of = np.array([k for k, r in enumerate(runs) for _ in r], np.int64)
        new = np.zeros((len(fresh), n + 1))
        flat = [w for r in runs for w in r]
        if flat and n:
            np.add.at(new[:, :n], of, forward(lattice, flat, model.probs))
        new[:, n] = [len(r) for r in runs]
        scores = np.concatenate([scores, new])
        langs, best = [], []
        for t in texts:
            at = [known[w] for w in t.split()]
            total = scores[at].sum(axis=0) if at else np.zeros(n + 1)
            if total[n] == 0 or not n:
                langs.append(UND)
                best.append(0.0)
                continue
            k = int(total[:n].argmax())
            langs.append(model.langs[k])
            best.append(float(1 / np.exp(np.clip(total[:n] - total[k], -700, 0)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                                         names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the likeliest language and its posterior under equal priors.

    Null, empty and letterless texts are ``und`` with score 0; a tie goes to
    the first language by name.  Only the two named columns are read.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lambda it: _predict(shared.value, it), schema(doc_id=LONG, lang_pred=STR, score=DBL))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    out = predict(docs, fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
