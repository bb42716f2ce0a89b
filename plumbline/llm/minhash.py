"""Near-duplicate documents by a chosen-path join over minwise tokens.

Documents become sets of hashed word shingles; equal sets form one class and only classes are compared. Several
independent trees start from one minwise token each: classes that share it meet in a node. A node of up to `LIMIT`
classes is compared exhaustively in its task, on short signatures; of the pairs that look similar enough it
hands on a spanning forest. A larger node compares all its classes with a hub and then branches, first by set size, then by further
minwise tokens chosen from its key; nodes whose classes all belong to one component already end there. Links are
confirmed on full sets, components follow from links. A last pass over the small nodes compares, in place, the full
sets of similar pairs that links have not connected yet. So a node hands on fewer pairs than it has classes, and
no node is gathered in a task unless it is small.

A pair of similarity s meets in the first token of a tree with probability s; twelve trees miss a pair at 0.8 with
probability 0.2 ** 12. Pairs are set aside by signatures of 64 tokens with a chance of `LOST`.

Defined results: null and empty texts, and texts of white space, have the empty set and link with nothing; texts
of fewer words than a shingle have the whole sequence as their one shingle; ties and repeated rows share a class;
rows with a null id get the smallest id of their component, null if there is none; an empty table gives no rows;
other columns are left out by near_duplicates and kept by deduplicate. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .shared import columns, components, drop, keep, passing, small_batches, store, table

TREES, TOKENS = 12, 64
#: The chance that two sets at the threshold show fewer equal tokens than asked for.
LOST = 1e-5
LIMIT, BRANCH, DEEPEST = 4096, 3, 16
#: Shingles of a block when full sets are compared in a node.
SHINGLES = 2_000_000


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, k: int):
    """Sorted distinct hashes of a text's word k-shingles, A-Z lower-cased."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    n = max(1, len(w) - k + 1)
    odd = _mix(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = np.full(n, odd[k] * np.uint64(min(len(w), k)), np.uint64)
    for i in range(min(k, len(w))):
        h += w[i : i + n] * odd[i]
    h = np.sort(_mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _signer():
    import numpy as np

    odd = _mix(np.arange(100, 100 + TOKENS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    salt = np.arange(TREES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def sign(s):
        low = np.full(TOKENS, np.uint64(2**64 - 1))
        for i in range(0, len(s), 4096):
            np.minimum(low, (s[i : i + 4096, None] * odd).min(axis=0), out=low)
        tokens = _mix(low)
        return _mix(tokens[:TREES] ^ salt).view(np.int64), (tokens & np.uint64(255)).astype(np.uint8).tobytes()

    return sign


def _classes(k: int):
    def run(batches):
        import numpy as np

        np.seterr(over="ignore")
        sign = _signer()
        for whole in batches:
            for batch in slices(whole, 2):
                n, cls, keys, sig = [], [], [], []
                for text in batch.column(2).to_pylist():
                    s = shingles(text, k)
                    n.append(len(s))
                    if len(s):
                        a, b = sign(s)
                        cls.append(_name(s))
                        keys.append(a.tolist())
                        sig.append(b)
                    else:
                        cls.append(None), keys.append(None), sig.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "tkey", "n_shingles", "cls", "keys", "sig"])

    return run


def _name(s) -> bytes:
    """A class's name: a hash of its set."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(k: int):
    def run(batches):
        import numpy as np

        np.seterr(over="ignore")
        for whole in batches:
            for batch in slices(whole, 0):
                sets = [shingles(t, k) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "words"])

    return run


def _sets_of(wanted: DataFrame, each: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """cls, words of the classes in wanted (cls), from the text of each one's representative.

    Texts that can't be one are left out before they move: representatives mark bits in a table of 2 ** 20 rows at most,
    16 MB whatever the corpus, which is broadcast. Texts that pass by chance go when classes are matched.
    """
    place, bit = (F.col("h").bitwiseAND((1 << 20) - 1)).alias("place"), F.shiftright("h", 20).bitwiseAND(63).cast("int")
    reps = wanted.join(each.select("cls", "rep"), "cls").select(F.xxhash64("rep.doc_id", "rep.tkey").alias("h"))
    marks = store(reps.select(place, F.expr("shiftleft(1L, CAST(shiftright(h, 20) & 63 AS INT))").alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits")), "marks")
    texts = keyed.withColumn("h", F.xxhash64("doc_id", "tkey")).select("text", place, bit.alias("bit")).join(F.broadcast(marks), "place")
    texts = texts.where(F.expr("(shiftright(bits, bit) & 1) = 1")).select(F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_sets(k), "cls binary, words binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    out = store(found, "sets")
    drop(marks)
    return out


def _groups(batches):
    """(classes, signatures, component numbers, rows) of each node of two or more, from rows sorted by key: key, cls, sig, comp, ..."""
    import numpy as np

    rest = None
    for batch in _and_end(batches):
        t = pa.Table.from_batches([batch]) if batch is not None else None
        t = pa.concat_tables([x for x in (rest, t) if x is not None]) if rest is not None or t is not None else None
        if t is None or not t.num_rows:
            continue
        key = t.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
        for x, y in zip(cuts[:-1], cuts[1:] if batch is None else cuts[1:-1], strict=False):
            if y - x > 1:
                rows, seen = t.slice(x, y - x), {}
                comp = np.array([seen.setdefault(c, len(seen)) for c in rows.column(3).to_pylist()])
                sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, TOKENS)
                yield rows.column(1).to_pylist(), np.ascontiguousarray(sig.T), comp, rows
        rest = t.slice(cuts[-2])


def _and_end(batches):
    yield from batches
    yield None


def alike(percent: int) -> int:
    """Equal tokens of TOKENS asked for before full sets are compared: what sets as similar as percent miss with chance LOST."""
    s, below, at = percent / 100, 0.0, 0
    while at < TOKENS and (below := below + math.comb(TOKENS, at) * s**at * (1 - s) ** (TOKENS - at)) < LOST:
        at += 1
    return at


def _equal(sig, u: int):
    """How many tokens of each class equal those of class u."""
    return (sig == sig[:, u : u + 1]).sum(axis=0, dtype="uint8").astype("int16")


def _written(pairs):
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def _forest(least: int):
    """A largest spanning forest of each node's similar pairs of different components, grown class by class."""

    def run(batches):
        import numpy as np

        pairs = []
        for cls, sig, comp, _ in _groups(batches):
            best, parent, done = np.zeros(len(cls), np.int16), np.zeros(len(cls), np.int64), np.zeros(len(cls), bool)
            for _ in cls:
                u = int(best.argmax())
                if least <= best[u] <= TOKENS:
                    pairs.append((cls[parent[u]], cls[u]))
                done[u] = True
                equal = _equal(sig, u)
                equal[comp == comp[u]] = TOKENS + 1
                nearer = ~done & (equal > best)
                best[nearer], parent[nearer] = equal[nearer], u
                best[u] = -1
            if len(pairs) > 20_000:
                yield _written(pairs)
                pairs = []
        yield _written(pairs)

    return run


def _unsettled(least: int):
    """Rows whose class has a similar one of another component in its node, parted by what similar pairs connect.

    A part's key is a hash of its classes, so that a family that meets in several trees is compared once.
    """

    def run(batches):
        import hashlib

        import numpy as np

        for cls, sig, comp, rows in _groups(batches):
            part, open_ = np.arange(len(cls)), np.zeros(len(cls), bool)
            for u in range(len(cls)):
                near = (_equal(sig, u) >= least) & (comp != comp[u])
                if near.any():
                    near[u] = open_[u] = True
                    met = np.unique(part[near])
                    if len(met) > 1:
                        part[np.isin(part, met)] = met[0]
            if open_.any():
                at = np.flatnonzero(open_)
                names = {x: int.from_bytes(hashlib.blake2b(b"".join(cls[i] for i in at[part[at] == x].tolist()), digest_size=8).digest(), "little", signed=True) for x in np.unique(part[at]).tolist()}
                found = rows.take(pa.array(at))
                yield from found.set_column(0, "key", pa.array([names[x] for x in part[at].tolist()], pa.int64())).to_batches()

    return run


def _links(percent: int):
    """Of each node's similar pairs of different components, linked ones that join them; full sets are compared in place."""

    def run(batches):
        import numpy as np

        pairs, least = [], alike(percent)
        for cls, sig, comp, rows in _groups(batches):
            words = [np.frombuffer(w, np.uint64) for w in rows.column(4).to_pylist()]
            size = np.array([len(w) for w in words])
            ends = np.cumsum(size)
            number = np.unique(np.concatenate(words), return_inverse=True)[1]
            sets = np.split(number, ends[:-1])
            mine = np.zeros(int(number.max()) + 1, bool)
            for u in range(len(cls) - 1):
                near = (_equal(sig, u) >= least) & (comp != comp[u]) & (100 * np.minimum(size, size[u]) >= percent * np.maximum(size, size[u]))
                near[: u + 1] = False
                mine[sets[u]] = True
                for v in np.flatnonzero(near).tolist():
                    if comp[v] == comp[u]:
                        continue
                    both = int(np.count_nonzero(mine[sets[v]]))
                    if 100 * both >= percent * (int(size[u]) + int(size[v]) - both):
                        comp[comp == comp[v]] = comp[u]
                        pairs.append((cls[u], cls[v]))
                mine[sets[u]] = False
            if len(pairs) > 20_000:
                yield _written(pairs)
                pairs = []
        yield _written(pairs)

    return run


def _in_nodes(rows: DataFrame) -> DataFrame:
    """Rows of nodes, those of a node together."""
    return rows.repartition("key").sortWithinPartitions("key", "cls")


def _settled(rows: DataFrame, each: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that the forests missed. Only classes that still may have one bring their sets to the node; one with
    more than SHINGLES is dealt in blocks, and every two of them meet."""
    left = store(_in_nodes(rows.select("key", "cls", "sig", "comp")).mapInArrow(_unsettled(alike(percent)), "key long, cls binary, sig binary, comp binary").dropDuplicates(["key", "cls"]), "unsettled")
    blocks = left.join(each.select("cls", "size"), "cls").groupBy("key").agg(F.ceil(F.sum("size") / SHINGLES).cast("int").alias("blocks"))
    cut = left.join(blocks, "key").withColumn("block", F.expr("CAST(pmod(xxhash64(cls, 7), blocks) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("key", F.xxhash64("key", F.lit("whole"), F.least("block", "other"), F.greatest("block", "other")))
    drop(rows)
    whole = cut.join(sets, "cls").select("key", "cls", "sig", "comp", "words")
    return store(_in_nodes(whole).mapInArrow(_links(percent), "a binary, b binary").distinct(), "more")


def _similar(least: int):
    def run(batches):
        import numpy as np

        for batch in batches:
            left = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, TOKENS)
            right = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, TOKENS)
            keep = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(keep), batch.column(3).filter(keep)], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        import numpy as np

        for whole in batches:
            for batch in slices(whole, 2):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked; each pair's sets are looked up and compared whole."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    return store(both.select("a", "b", "wa", "wb").mapInArrow(_confirm(percent), "a binary, b binary, linked boolean"), "confirmed")


def _joined(labels: DataFrame | None, tested: DataFrame) -> DataFrame:
    """Components after links: the old ones' stars and the new links are joined."""
    links = tested.where("linked").select("a", "b")
    if labels is None:
        return store(components(links), "components")
    return labels if links.isEmpty() else store(components(labels.select(F.col("v").alias("a"), F.col("c").alias("b")).union(links)), "components")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = rows.drop("comp")
    if labels is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(labels.select(F.col("v").alias("cls"), "c"), "cls", "left").withColumn("comp", F.coalesce("c", "cls")).drop("c")


def _alive(rows: DataFrame, name: str) -> DataFrame:
    """Rows in nodes of two or more classes that are not all of one component; n: the node's classes."""
    nodes = store(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("n > 1 AND low <> high").select("key", "n"), "nodes")
    out = store(rows.join(nodes, "key"), name)
    drop(nodes)
    return out


def _thin_and_thick(impure: DataFrame) -> DataFrame:
    """impure with main, a node's most frequent component, and few: whether up to LIMIT classes are of others."""
    most = impure.groupBy("key", "n", "comp").agg(F.count("*").alias("m")).groupBy("key", "n").agg(F.max(F.struct("m", "comp")).alias("top"))
    nodes = store(most.select("key", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.m") <= LIMIT).alias("few")), "mains")
    return store(impure.join(nodes, "key"), "split")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nodes of one component and few others: blocks of the one, the others added to each, as small nodes."""
    cut = rows.withColumn("blocks", F.ceil(F.col("n") / LIMIT).cast("int"))
    own = F.array(F.expr("CAST(pmod(xxhash64(cls, 7), blocks) AS INT)"))
    cut = cut.withColumn("block", F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return cut.select(F.expr("xxhash64(key, 'block', block)").alias("key"), "cls", "sig", "comp", F.lit(2).cast("long").alias("n"))


def _by_size(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Nodes parted by set size: sets as similar as percent lie in one band or in two that touch, so no link is lost."""
    width = math.log(100 / min(percent, 99)) * (1 + 1e-9)  # sizes at the very threshold differ by less than a band
    cut = rows.join(sizes, "cls").withColumn("low", F.floor(F.log("size") / width)).withColumn("band", F.explode(F.array("low", F.col("low") + 1)))
    return cut.select(F.expr("xxhash64(key, 'size', band)").alias("key"), "cls", "sig", "comp")


def _all_blocks(rows: DataFrame) -> DataFrame:
    """Nodes that no branching parts: every two of their blocks as a small node."""
    cut = rows.withColumn("blocks", F.ceil(F.col("n") / (LIMIT // 2)).cast("int")).withColumn("block", F.expr("CAST(pmod(xxhash64(cls, 7), blocks) AS INT)"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select(F.xxhash64("key", F.lit("pair"), F.least("block", "other"), F.greatest("block", "other")).alias("key"), "cls", "sig", "comp", F.lit(2).cast("long").alias("n"))


def classes(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, tkey, n_shingles, comp of each row of docs (doc_id, text); comp is null where the set is empty."""
    small_batches(docs.sparkSession)
    with passing():
        return keep(store(_classified(docs, k, percent), "placed"))


def _classified(docs: DataFrame, k: int, percent: int) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    prepared = store(keyed.select("doc_id", "tkey", F.col("text").cast("binary").alias("text")).mapInArrow(_classes(k), "doc_id long, tkey long, n_shingles long, cls binary, keys array<long>, sig binary"), "prepared")
    each = store(prepared.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")).alias("rep"), F.max("keys").alias("keys"), F.max("sig").alias("sig"), F.max("n_shingles").alias("size")), "classes")
    # keys alone find the nodes of two or more; only their rows get signatures
    pairs = each.select("cls", F.explode("keys").alias("key"))
    nodes = store(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    rows = store(pairs.join(nodes, "key").join(each.select("cls", "sig"), "cls").select("key", "cls", "sig", F.col("cls").alias("comp"), "n"), "alive")
    drop(nodes)
    smalls, tested, sets, labels, levels = [], [], None, None, [rows]
    depth = 0
    while True:
        small, big = rows.where(F.col("n") <= LIMIT), rows.where(F.col("n") > LIMIT)
        smalls.append(small)
        found = store(_in_nodes(small.select("key", "cls", "sig", "comp")).mapInArrow(_forest(alike(percent)), "a binary, b binary").distinct(), "forest")
        any_big = not big.isEmpty()
        if any_big:
            hubs = store(big.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "cls").alias("o"), "cls", "sig")).alias("hub")).select("key", F.col("hub.cls").alias("h"), F.col("hub.sig").alias("hsig")), "hubs")
            near = big.join(hubs, "key").where("cls <> h").select("sig", "hsig", F.least("cls", "h").alias("a"), F.greatest("cls", "h").alias("b"))
            found = store(found.union(near.mapInArrow(_similar(alike(percent)), "a binary, b binary")).distinct(), "candidates")
        for done in tested:
            found = found.join(done, ["a", "b"], "left_anti")
        met = found.select(F.col("a").alias("cls")).union(found.select(F.col("b").alias("cls"))).distinct()
        if sets is None:
            sets = _sets_of(met, each, keyed, k)
        elif not (more := store(met.join(sets, "cls", "left_anti"), "met")).isEmpty():
            sets = sets.union(_sets_of(more, each, keyed, k))
        tested.append(_confirmed(found, sets, percent))
        labels = _joined(labels, tested[-1])
        if not any_big:
            break
        impure = _thin_and_thick(_alive(_labelled(big, labels).select("key", "cls", "sig", "comp"), "mixed"))
        thick = impure.where(~F.col("few"))
        depth += 1
        if depth == 1:
            child = _alive(_by_size(thick, each.select("cls", "size"), percent), "alive")
        elif depth < DEEPEST:
            place = F.expr(f"CAST(pmod(xxhash64(key, choice), {TOKENS}) AS INT) + 1")
            child = thick.withColumn("choice", F.explode(F.sequence(F.lit(1), F.lit(BRANCH)))).withColumn("at", place)
            child = _alive(child.select(F.expr("xxhash64(key, choice, substr(sig, at, 1))").alias("key"), "cls", "sig", "comp"), "alive")
        else:
            child = _all_blocks(thick)
        rows = store(child.select("key", "cls", "sig", "comp", "n").union(_blocks(impure.where("few"))), "next")
        levels.append(rows)
        if rows.isEmpty():
            break
    last = None
    for small in smalls:
        rows = _labelled(small.select("key", "cls", "sig"), labels)
        last = rows.select("key", "cls", "sig", "comp") if last is None else last.union(rows.select("key", "cls", "sig", "comp"))
    last = _alive(last, "last")
    drop(*levels)
    more = _settled(last, each, sets, percent)
    labels = _joined(labels, more.withColumn("linked", F.lit(True)))
    placed = prepared.where("cls IS NOT NULL").select("doc_id", "tkey", "n_shingles", "cls").join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("doc_id", "tkey", "n_shingles", F.coalesce("c", "cls").alias("comp"))
    return placed.union(prepared.where("cls IS NULL").select("doc_id", "tkey", "n_shingles", F.lit(None).cast("binary")))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    placed = classes(docs, k, percent)
    alone, rest = placed.where("comp IS NULL"), placed.where("comp IS NOT NULL")
    least = store(rest.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = rest.join(least, "comp").select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component, one for each; rows with an empty set all stay."""
    placed = classes(columns(docs, "doc_id", "text"), k, percent)
    first = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")).alias("rep"))
    first = store(first.select(F.col("rep.doc_id").alias("_d"), F.col("rep.tkey").alias("_k")), "first")
    keyed = docs.withColumn("_tkey", F.xxhash64("text"))
    empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\f\r ", "")) == ""
    chosen = keyed.where(~empty).join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tkey") == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "_tkey"])
    return chosen.drop("_tkey").union(docs.where(empty))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
