"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, replaces letters of other scripts and digits that stand for Latin letters, and drops what has
no width. The lexicon is learned from labelled documents: words and beginnings of words that stand in toxic
documents far more often than in others, weighted by log odds. Phrases of a lexicon entry and a neighbouring word
that labelled documents use without being toxic are exceptions: hits inside them don't count. A document's
weights are summed, divided by its length, and turned into a score by a logistic curve fitted to the same
documents. Labels, lang, source and doc_id are never part of a score.

Defined results: null and empty texts, and texts without words, have no hits and get the curve's lowest score;
whole texts are scored, of any length; repeated rows get equal scores; a null id is not held out and never
learned from; without labelled documents of both kinds every score is 0; an empty table gives no rows. Documents
with several labels count as toxic if one says so; null labels are left out.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .shared import columns, small_batches, store, table

#: Labelled documents of each kind that the lexicon is learned from, at most: those first by a hash of their id.
LEARNED = 10_000
#: An entry stands in so many toxic documents, and in that share of them, and its odds are raised so many times.
SUPPORT, SHARE, RAISED = 3, 0.01, 20.0
BEGINNINGS = (4, 5, 6, 7)

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнгαορνικτυεгωϲ", "aeopcyxijsdhikmtbhraopviktuerwc", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_TABLE = str.maketrans({**HOMOGLYPHS, **SUBSTITUTES, **{c: None for c in INVISIBLE}})
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """A text's folded words, a space before and after each; a space for no words."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _GAPS.sub(" ", f" {text.lower().translate(_TABLE)} ")


def features(folded: str) -> set[str]:
    """A document's words, and the beginnings of longer words; each after the space before it."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if len(w) >= n)
    return out


def _spellings(entry: str) -> set[str]:
    """An entry, and how it folds where 1 stands for l."""
    return {entry, entry.replace("l", "i")} | {entry[:i] + "i" + entry[i + 1 :] for i, c in enumerate(entry) if c == "l"}


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            for s in _spellings(entry):
                if s not in self.automaton:
                    self.automaton.add_word(s, (len(s), weight, entry))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0, ""))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, entry), outside exceptions."""
        if not len(self.automaton):
            return []
        found = [(end + 1 - n, end + 1, weight, entry) for end, (n, weight, entry) in self.automaton.iter(folded)]
        out = sorted((a, b) for a, b, _, entry in found if not entry)
        if not out:
            return found
        starts, furthest = [a for a, _ in out], list(itertools.accumulate((b for _, b in out), max))  # the furthest end of those that start so far
        return [f for f in found if f[3] and not ((k := bisect.bisect_right(starts, f[0])) and furthest[k - 1] >= f[1])]

    def inputs(self, folded: str) -> tuple[float, float]:
        """Weight by length, and hits up to three."""
        import math

        hits = self.hits(folded)
        return math.log1p(1000 * sum(h[2] for h in hits) / max(1, folded.count(" ") - 1)), float(min(3, len({h[0] for h in hits})))


def _minwise(folded: str) -> int:
    """One minwise token of a document's word triples: near copies mostly share it."""
    import xxhash

    w = folded.split()
    return min(xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))) >> 1


def _folded(batches):
    for whole in batches:
        for batch in slices(whole, 1):
            f = [fold(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_minwise(x) for x in f], pa.int64()), pa.array(f)], names=["toxic", "near", "folded"])


def _counted(of):
    """Documents of each kind that each feature stands in."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["f", "t", "c"])

        for batch in batches:
            for toxic, folded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in of(folded):
                    counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    return run


def entries(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of words and beginnings (documents, weight) those to match: a whole word where it makes up nearly all of its
    beginnings' documents, else the shortest beginning that no longer one betters."""
    best: dict[str, float] = {}
    most: dict[str, int] = {}
    for f, (t, w) in found.items():
        for i in range(2, len(f)):
            best[f[:i]] = max(best.get(f[:i], 0.0), w)
            if f.endswith(" "):
                most[f[:i]] = max(most.get(f[:i], 0), t)
    out: dict[str, float] = {}
    for f in sorted(found, key=lambda f: (len(f.strip()), f.endswith(" "), f)):
        t, w = found[f]
        if any(f[:i] in out for i in range(2, len(f))):
            continue
        if f.endswith(" ") or (best.get(f, 0.0) <= w + 0.4 and most.get(f, 0) < 0.9 * t):
            out[f] = w
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[dict[str, float], list[str], list[float]]:
    """(entries' weights, exception phrases, curve) from docs (doc_id, text) and labels (doc_id, toxic)."""
    import math

    import numpy as np

    small_batches(docs.sparkSession)
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARNED) for k in (0, 1)]
    chosen = store(of[0].union(of[1]), "labelled")  # 20,000 rows at most, so it is broadcast
    rows = store(docs.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), text).mapInArrow(_folded, "toxic int, near long, folded string").groupBy("toxic", "near").agg(F.min("folded").alias("folded")), "folded")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}, [], []
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    kind = "f string, t long, c long"
    counts = rows.select("toxic", "folded").mapInArrow(_counted(features), kind).groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = counts.where(F.col("t") >= max(SUPPORT, SHARE * n[1])).withColumn("w", odds).where(F.col("w") >= math.log(RAISED)).collect()  # of a bounded sample, each in SHARE of its toxic documents
    lexicon = entries({r.f: (r.t, r.w) for r in found})
    plain = Matcher(lexicon)

    def phrases(folded: str) -> set[str]:
        out = set()
        for a, b, _, _ in plain.hits(folded):
            end = folded.index(" ", b - 1 if folded[b - 1] == " " else b) + 1
            before, after = folded.rfind(" ", 0, a), folded.find(" ", end)
            if a > 0 and before >= 0:
                out.add(folded[before:end])
            if after > 0:
                out.add(folded[a : after + 1])
        return out

    counts = rows.select("toxic", "folded").mapInArrow(_counted(phrases), kind).groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    exceptions = [r.f for r in counts.where((F.col("c") >= SUPPORT) & (odds <= 0)).collect()]  # words around entries, of the same sample
    matcher = Matcher(lexicon, exceptions)

    def measured(batches):
        for batch in batches:
            x = [matcher.inputs(f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["y", "a", "b"])

    got = rows.select("toxic", "folded").mapInArrow(measured, "y int, a double, b double").groupBy("y", F.round("a", 2).alias("a"), "b").count().orderBy("y", "a", "b").toPandas()  # of 20,000 rows at most
    x = np.column_stack([np.ones(len(got)), got.a, got.b])
    y, count = got.y.to_numpy(float), got["count"].to_numpy(float)
    b = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-3, 1e-3]), x.T @ (count * (y - p)) - np.array([0, 1e-3, 1e-3]) * b)
        b += step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return lexicon, exceptions, b.tolist()


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs without text, with score and predicted."""
    from pyspark.sql import types as T

    lexicon, exceptions, curve = model
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]

    def run(batches):
        import math

        matcher = Matcher(lexicon, exceptions)
        for whole in batches:
            for batch in slices(whole, len(others)):
                got = []
                for t in batch.column(len(others)).to_pylist():
                    a, b = matcher.inputs(fold(t)) if curve else (0.0, 0.0)
                    got.append(1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] + curve[1] * a + curve[2] * b)))) if curve else 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], names=[*others, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*others, text).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark, sf_dir: str, docs: DataFrame) -> tuple:
    labels = columns(table(spark, sf_dir, "labels"), "doc_id", "toxic").where(~held_out())
    return learn(columns(docs, "doc_id", "text"), labels)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score(docs.withColumn("held_out", held_out()), train(spark, sf_dir, docs)).select("doc_id", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    lexicon, exceptions, curve = model

    def run(batches):
        matcher = Matcher(lexicon, exceptions)
        for whole in batches:
            at = whole.schema.names.index(text)
            for batch in slices(whole, at):
                x = [matcher.inputs(fold(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not curve or curve[0] + curve[1] * a + curve[2] * b < 0 for a, b in x], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
