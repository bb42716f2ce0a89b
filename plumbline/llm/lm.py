"""Masked pseudo-likelihood: a small network predicts every token from the tokens on both sides.

Tokens are words, A-Z lower-cased, each with its own count in a distributed table. The softmax over the vocabulary is
factored: a word belongs to one class, the network gives the classes' probabilities from both sides, and within a
class a word has its share of the counts. Frequent words are classes of their own. The others are grouped by the
company they keep: a document's vector is the normalised sum of random vectors of its words, a word's is the mean of
its documents', and k-means over all words parts them, weighted by their counts; a group's words in order of frequency
are split into classes of about equal mass. There are as many classes as the cube root of the words and 64 at least, a
sixth as many groups. The network sees the classes of two tokens to the left and two to the right, never the token's
own. A document's score is the sum of its tokens' log-probabilities. Documents are numbered chunk by chunk by the words
of the chunk, and only the distinct words of a chunk are joined with the table, by 64-bit hashes.

Training is numpy. Documents are dealt by a hash to rounds and, in a round, to shards of about `SHARD` tokens; a shard
is one descent over its documents in order, from the round's weights, which are averaged by tokens seen after it. All
documents are learned from once. Sums are of whole numbers, so neither files nor partitions change a result.

A word that the table lacks counts as one of count 0, in the last class; one is added to each count.

Defined results: null and empty texts have no tokens, log_prob 0 and per_token null; whole texts are scored, of any
length; repeated rows count as often as they stand there and get equal scores; null ids are kept; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .shared import columns, drop, keep, passing, small_batches, spent, store, table

LEAST, HIDDEN, ROUNDS, RATE, BATCH = 64, 8, 3, 2.0, 1024
SIDES = (-2, -1, 1, 2)
#: The class beyond a document's ends: the last row of a side's table, however many classes there are.
CLASSES = -1
#: Tokens of a chunk and of a shard, and words that a lookup fetches at once.
CHUNK, SHARD, FETCHED = 2_000_000, 4_000_000, 10_000
#: Chunks are joined with the words' table in so many passes, so that only a part of them is shuffled at a time.
PASSES = 2
#: Random vectors of words, by a hash, and their dimensions; k-means starts from so many frequent words, and its rounds.
BUCKETS, WIDTH, FIRST, TURNS = 4096, 8, 2048, 3
#: A document's vector has this length, so sums of up to MOST tokens' vectors fit in 16 bits.
STEP, MOST = 63, 520
#: Averaged weights are whole multiples of 1 / UNIT.
UNIT = 1 << 24


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _word(w: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(w)
    return h - (1 << 64) if h >> 63 else h


def _stored(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """A working table; shuffle files of each part are gone before the next is begun."""
    with spent(df.sparkSession):
        return store(df, name, "zstd", *more)


def _company(words, flat, sizes):
    """For each word the sum of its documents' vectors, once for each token, in whole steps."""
    import numpy as np

    table = np.random.default_rng(1).normal(size=(WIDTH, BUCKETS)).astype(np.float32)
    bucket = words % BUCKETS
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    vec = np.stack([np.bincount(doc, weights=table[d][bucket][flat], minlength=len(sizes)) for d in range(WIDTH)])
    vec = np.rint(STEP * vec / np.maximum(1e-9, np.sqrt((vec * vec).sum(axis=0))))
    return [np.bincount(flat, weights=vec[d][doc], minlength=len(words)).astype(np.int64) for d in range(WIDTH)]


def _encoded(batches):
    """Rows of documents, their tokens as places in their chunk's words, compressed; rows of the chunk's words, with
    counts and company, four sums a number. What exceeds 16 bits goes on in rows without a place."""
    import numpy as np
    import xxhash
    import zstandard

    names = ["chunk", "doc_id", "ids", "word", "place", "n", "v0", "v1"]
    press = zstandard.ZstdCompressor(level=1)

    def numbers():  # words are numbered as they come
        return defaultdict(itertools.count().__next__)

    def packed(sums):
        return [sum((sums[4 * h + i] & 0xFFFF) << (16 * i) for i in range(4)).view(np.int64) for h in range(2)]

    def written(known, docs, ids):
        chunk, words = uuid.uuid4().int >> 65, np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)).view(np.int64)
        flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
        for i in range(0, len(docs), 10_000):
            d = docs[i : i + 10_000]
            no = [pa.nulls(len(d), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(d), pa.int64()), pa.array(d, pa.int64()), pa.array([press.compress(x.tobytes()) for x in ids[i : i + 10_000]], pa.binary()), *no], names=names)
        counts, sums = np.bincount(flat, minlength=len(words)), _company(words, flat, sizes)
        place, n = np.arange(len(words)), counts
        while len(place):
            turns = -(-n // MOST)  # rows still to come for these words, this one included
            part = [np.trunc(x[place] / turns).astype(np.int64) for x in sums]
            for x, y in zip(sums, part, strict=True):
                x[place] -= y
            first, lanes = n is counts, packed(part)
            now = np.where(turns > 1, n - (turns - 1) * MOST, n)
            for i in range(0, len(place), 50_000):
                at = slice(i, i + 50_000)
                k = len(place[at])
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(words[place[at]]), pa.array(place[at].astype(np.int32)) if first else pa.nulls(k, pa.int32()), pa.array(now[at]), *[pa.array(x[at]) for x in lanes]], names=names)
            more = turns > 1
            place, n = place[more], ((turns - 1) * MOST)[more]

    known, docs, ids, held = numbers(), [], [], 0
    for whole in batches:
        for batch in slices(whole, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                got = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                docs.append(doc), ids.append(got)
                held += len(got) + 16
                if held > CHUNK:
                    yield from written(known, docs, ids)
                    known, docs, ids, held = numbers(), [], [], 0
    if docs:
        yield from written(known, docs, ids)


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    number = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    given = docs.select(number.cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return _stored(given.mapInArrow(_encoded, "chunk long, doc_id long, ids binary, word long, place int, n long, v0 long, v1 long"), "encoded")


class Words:
    """The table word, cls, share. words[w] looks a single one up: its class, or its log share in the class."""

    def __init__(self, rows: DataFrame, column: str, unseen):
        self.rows, self.column, self.unseen, self.known = rows, column, unseen, None

    def __getitem__(self, word: bytes):
        if self.known is None:
            self.known = {r.word: r[self.column] for r in self.rows.limit(FETCHED).collect()}  # FETCHED rows
        key = _word(word)
        if key not in self.known:
            r = self.rows.where(F.col("word") == F.lit(key)).first()
            self.known[key] = r[self.column] if r else self.unseen
        return self.known[key]


def class_count(words: int) -> int:
    return max(LEAST, math.ceil(words ** (1 / 3)))


def _vectors(batch):
    """Words' vectors from a number each, eight bytes of it."""
    import numpy as np

    return batch.column(2).to_numpy().view(np.int8).reshape(-1, WIDTH)


def _nearest(x, centres):
    """The nearest centre of each vector; of equally near ones the first."""
    import numpy as np

    c = np.array(centres, np.float64)
    far = (c * c).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 65_536].astype(np.float64) @ (-2 * c.T) + far).argmin(axis=1) for i in range(0, len(x), 65_536)]])


def _grouper(centres):
    """word, n, grp of each word."""

    def run(batches):
        import numpy as np

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_nearest(_vectors(batch), centres).astype(np.int32))], names=["word", "n", "grp"])

    return run


def _summer(centres):
    """grp, n and the sums of a batch's words' vectors, whole numbers."""

    def run(batches):
        import numpy as np

        for batch in batches:
            x, n = _vectors(batch).astype(np.float64), batch.column(1).to_numpy().astype(np.float64)
            grp = _nearest(x, centres)
            sums = [np.bincount(grp, weights=n * w, minlength=len(centres)).astype(np.int64) for w in (np.ones(len(n)), *x.T)]  # below 2 ** 53, so exact
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), *map(pa.array, sums)], names=["grp", "n", *[f"s{d}" for d in range(WIDTH)]])

    return run


def _centres(counted: DataFrame, many: int):
    """Centres of many groups of words: k-means over all of them, started from frequent ones far apart."""
    import numpy as np

    first = counted.orderBy(F.desc("n"), "word").limit(FIRST).collect()  # FIRST rows
    x, w = np.array([r.x for r in first], np.int64).view(np.int8).reshape(-1, WIDTH).astype(float), np.array([r.n for r in first], float)
    centres, far = [], np.full(len(x), np.inf)
    for _ in range(min(many, len(x))):
        at = int((np.where(np.isinf(far), 1.0, far) * w).argmax())
        centres.append(x[at].tolist())
        far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
    for _ in range(TURNS if centres else 0):
        rows = counted.mapInArrow(_summer(centres), "grp int, n long, " + ", ".join(f"s{d} long" for d in range(WIDTH)))
        for r in rows.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(WIDTH)]).collect():  # a row a group
            if r.n:
                centres[r.grp] = [r[f"s{d}"] / r.n for d in range(WIDTH)]
    return centres


def classes(parts: DataFrame) -> tuple[Words, Words, int]:
    """(class of each word, log share of each word in its class, number of classes), one added to each count.

    A word of twice a class's mass is a class. In a group words come in order of frequency to a sixteenth of a
    doubling, then of a hash; groups come by mass, the largest last.
    """
    spark = parts.sparkSession
    lanes = [F.shiftright(F.shiftleft(f"v{d // 4}", 48 - 16 * (d % 4)), 48).alias(f"s{d}") for d in range(WIDTH)]
    sums = parts.where("word IS NOT NULL").select("word", "n", *lanes).groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(WIDTH)])
    means = " | ".join(f"shiftleft(CAST(round(s{d} / n) AS BIGINT) & 255L, {8 * d})" for d in range(WIDTH))
    counted = _stored(sums.select("word", (F.col("n") + 1).alias("n"), F.expr(means).alias("x")), "counted")
    words, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = class_count(words)
    placed = _stored(counted.mapInArrow(_grouper(_centres(counted, max(1, many // 6))), "word long, n long, grp int").withColumn("bin", F.floor(16 * F.log2("n")).cast("int")), "grouped")
    own = placed.where(F.col("n") > 2 * total / many).orderBy(F.desc("n"), "word").select("word", "n").collect()  # of less than half the classes
    rest = placed.where(F.col("n") <= 2 * total / many)
    bins = rest.groupBy("grp", "bin").agg(F.sum("n").alias("mass")).collect()  # 16 rows a doubling and group
    mass: dict[int, int] = {}
    for r in bins:
        mass[r.grp] = mass.get(r.grp, 0) + r.mass
    order = sorted(mass, key=lambda g: (mass[g], g))
    left, base, at = many - len(own), {}, len(own)
    shares = {g: max(1, left * mass[g] // max(1, sum(mass.values()))) for g in order}
    if order:
        shares[order[-1]] = left - sum(shares[g] for g in order[:-1])
    for g in order:
        base[g], at = at, at + shares[g]
    rules, before = [], dict.fromkeys(order, 0)
    for r in sorted(bins, key=lambda r: (r.grp, -r.bin)):
        rules.append((r.grp, r.bin, float(before[r.grp]), float(r.mass), base[r.grp], shares[r.grp], float(mass[r.grp])))
        before[r.grp] += r.mass
    place = F.col("before") + F.col("mass") * (F.expr("pmod(xxhash64(word), 1000003)") / 1000003)
    given = F.broadcast(spark.createDataFrame(rules, "grp int, bin int, before double, mass double, base int, shares int, whole double"))
    cut = rest.join(given, ["grp", "bin"]).select("word", "n", (F.col("base") + F.least(F.col("shares") - 1, F.floor(place / F.col("whole") * F.col("shares")).cast("int"))).alias("cls"))
    alone = spark.createDataFrame([(r.word, r.n, i) for i, r in enumerate(own)], "word long, n long, cls int")
    cut = _stored(cut.union(alone), "classed")
    drop(counted, placed)
    of = {r.cls: r.mass for r in cut.groupBy("cls").agg(F.sum("n").alias("mass")).collect()}  # a row a class
    of[many - 1] = of.get(many - 1, 0) + 1
    given = spark.createDataFrame([(c, float(m)) for c, m in of.items()], "cls int, mass double")
    rows = _stored(cut.join(F.broadcast(given), "cls").select("word", "cls", F.log(F.col("n") / F.col("mass")).alias("share")), "words")
    drop(cut)
    return Words(rows, "cls", many - 1), Words(rows, "share", -math.log(of[many - 1])), many


def coded(parts: DataFrame, cls: Words, share: Words) -> DataFrame:
    """doc_id, codes, share of each document: its tokens' classes and the sum of their log shares."""

    def run(docs, words):
        import numpy as np
        import zstandard

        kind, part = np.zeros(words.num_rows, np.uint16), np.zeros(words.num_rows)
        place = words.column("place").to_numpy()
        kind[place], part[place] = words.column("cls").to_numpy(), words.column("share").to_numpy()
        press = zstandard.ZstdDecompressor()
        ids = [press.decompress(i) for i in docs.column("ids").to_pylist()]
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), np.int32)
        ends, sums, codes = np.cumsum(sizes), np.concatenate([[0.0], np.cumsum(part[flat])]), kind[flat]
        return pa.table({"doc_id": docs.column("doc_id"), "codes": pa.array([codes[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()), "share": pa.array(sums[ends] - sums[ends - sizes])})

    def joined(turn):
        own = parts.where(F.expr(f"pmod(chunk, {PASSES}) = {turn}"))
        docs = own.where("ids IS NOT NULL").select("chunk", "doc_id", "ids")
        found = own.where("place IS NOT NULL").select("chunk", "word", "place").join(cls.rows, "word", "left")
        found = found.select(F.col("chunk").alias("of"), "place", F.coalesce("cls", F.lit(cls.unseen)).alias("cls"), F.coalesce("share", F.lit(share.unseen)).alias("share"))
        return docs.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, "doc_id long, codes binary, share double")

    first, *more = [joined(turn) for turn in range(PASSES)]
    return _stored(first, "coded", *more)


def _each(batches, at: int):
    """Parts of batches with the classes of all their tokens, and each document's number of them."""
    import numpy as np

    for whole in batches:
        for batch in slices(whole, at):
            codes = batch.column(at).to_pylist()
            yield batch, np.frombuffer(b"".join(codes), np.uint16).astype(np.int64), np.array([len(c) // 2 for c in codes], np.int64)


def start(many: int):
    """The network's first weights: a table of hidden inputs for each side, biases, the output layer."""
    import numpy as np

    rng = np.random.default_rng(2)
    return [rng.normal(0, 0.1, (len(SIDES), many + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, many)), np.zeros(many)]


def _context(cls, sizes):
    """Classes on each side of every token; CLASSES beyond a document's ends."""
    import numpy as np

    wide = max(map(abs, SIDES))  # so many places lie between two documents
    at = np.arange(len(cls)) + np.repeat(wide * np.arange(1, len(sizes) + 1), sizes)
    row = np.full(len(cls) + wide * (len(sizes) + 1), CLASSES)
    row[at] = cls
    out = np.empty((len(SIDES), len(cls)), row.dtype)
    for s, d in enumerate(SIDES):
        out[s] = row[at + d]
    return out


def _places(tables, context):
    """Rows of all sides' tables in one, in the place of the classes."""
    import numpy as np

    rows = tables.shape[1]
    context %= rows
    context += (np.arange(len(SIDES)) * rows)[:, None]
    return context


def _hidden(weights, places):
    import numpy as np

    return np.tanh(weights[0].reshape(-1, HIDDEN).take(places, axis=0).sum(axis=0) + weights[1])


def _forward(weights, places):
    """Hidden units and the classes' probabilities."""
    import numpy as np

    hidden = _hidden(weights, places)
    p = hidden @ weights[2]
    p += weights[3]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return hidden, p


def fit(weights, cls, sizes, rate: float = RATE):
    """One pass of stochastic descent over the tokens."""
    import numpy as np

    tables = weights[0]
    places = _places(tables, _context(cls, sizes))
    for i in range(0, len(cls), BATCH):
        at, y = places[:, i : i + BATCH], cls[i : i + BATCH]
        hidden, p = _forward(weights, at)
        p[np.arange(len(y)), y] -= 1
        p *= rate / BATCH
        back = (p @ weights[2].T) * (1 - hidden * hidden)
        weights[2] -= hidden.T @ p
        weights[3] -= p.sum(axis=0)
        weights[1] -= back.sum(axis=0)
        at, back = at.ravel(), np.tile(back.T.astype(np.float64), len(SIDES))
        moved = np.stack([np.bincount(at, weights=b, minlength=tables.size // HIDDEN) for b in back], axis=1)
        tables -= moved.reshape(tables.shape).astype(np.float32)
    return weights


def _flat(weights):
    import numpy as np

    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat):
    import numpy as np

    out, at = [], 0
    inputs = (len(SIDES) + 1) * HIDDEN
    for w in start((len(flat) - inputs) // (inputs + 1)):
        out.append(np.array(flat[at : at + w.size], np.float32).reshape(w.shape))
        at += w.size
    return out


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, codes and deal of all coded documents, and how many shards a round has."""
    total = rows.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0] // 2
    return rows.select("doc_id", "codes", F.xxhash64("doc_id", "codes").alias("deal")), max(1, math.ceil(total / (SHARD * ROUNDS)))


def _learner(given):
    """A shard's weights in steps of 1 / UNIT, and its tokens."""

    def learned(table):
        import numpy as np

        table = table.sort_by([("doc_id", "ascending"), ("codes", "ascending")])
        weights, seen = _shaped(given.value), 0
        for _, cls, sizes in _each(table.to_batches(), 1):
            if len(cls):
                weights, seen = fit(weights, cls, sizes), seen + len(cls)
        w = np.rint(_flat(weights).astype(np.float64) * UNIT).astype(np.int64)
        return pa.table({"i": pa.array(range(len(w)), pa.int32()), "w": pa.array(w), "n": pa.array([seen] * len(w), pa.int64())})

    return learned


def _learned(rows: DataFrame, many: int, rounds: int):
    """The weights after some rounds, each over its share of all coded documents."""
    spark, flat = rows.sparkSession, _flat(start(many))
    dealt, shards = _dealt(rows)
    for k in range(rounds):
        given = spark.sparkContext.broadcast(flat)  # as large as the network

        part = dealt.where(F.expr(f"pmod(deal, {rounds}) = {k}")).withColumn("shard", F.expr(f"pmod(deal DIV {rounds}, {shards})")).select("doc_id", "codes", "shard")
        exact = F.sum(F.col("w").cast("decimal(38,0)") * F.col("n"))
        got = part.groupBy("shard").applyInArrow(_learner(given), "i int, w long, n long").where("n > 0").groupBy("i").agg(exact.alias("w"), F.sum("n").alias("n")).collect()  # one row a weight
        for r in got:
            flat[r.i] = float(r.w) / r.n / UNIT
    return flat


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple:
    """(class of each word, log shares, weights) from all of docs."""
    parts = encode(docs, text)
    cls, share, many = classes(parts)
    return cls, share, _learned(coded(parts, cls, share), many, rounds)


def log_probs(weights, cls, sizes):
    """Log-probability of each token's class given its neighbours."""
    import numpy as np

    places, out = _places(weights[0], _context(cls, sizes)), np.empty(len(cls))
    both, ones = np.vstack([weights[2], weights[3]]), np.ones(len(weights[3]), weights[3].dtype)
    large = np.abs(both).sum(axis=0).max() > 60  # hidden units are below one, so else exp() doesn't overflow
    for i in range(0, len(cls), BATCH):
        hidden = _hidden(weights, places[:, i : i + BATCH])
        z = np.hstack([hidden, np.ones((len(hidden), 1), hidden.dtype)]) @ both
        if large:
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), cls[i : i + BATCH]]
        out[i : i + BATCH] = own - np.log(np.exp(z, out=z) @ ones)
    return np.maximum(out, math.log(1e-30))


def _scored(rows: DataFrame, flat) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        import numpy as np

        weights = _shaped(given.value)
        for batch, cls, sizes in _each(batches, 1):
            sums = np.concatenate([[0.0], np.cumsum(log_probs(weights, cls, sizes))])
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes] + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total), pa.array(np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0), mask=sizes == 0)], names=["doc_id", "n_tokens", "log_prob", "per_token"])

    return rows.select("doc_id", "codes", "share").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, per_token double")


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, n_tokens, log_prob, per_token of docs (doc_id, text)."""
    cls, share, flat = model
    return _scored(coded(encode(docs), cls, share), flat)


def op2(spark, sf_dir: str) -> DataFrame:
    with passing():
        parts = encode(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
        cls, share, many = classes(parts)
        rows = keep(coded(parts, cls, share))
    return _scored(rows, _learned(rows, many, ROUNDS))
