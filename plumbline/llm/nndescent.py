"""Near-duplicate vectors by NN-descent.

Vectors of one label are compared, equal ones as one class. Random hyperplanes deal classes to small blocks, whose
best pairs start a graph of each class's nearest neighbours. A round joins, at every class, its neighbours and
those it is a neighbour of; what is nearer than a list's last enters it, and nothing else leaves the task that
compared it. Two that were neighbours of a class the round before aren't compared there again. Lists whose neighbours are all links are
saturated and may grow to four times their length. An audit compares a few classes with all of their label: for each
component, what share of its classes' links lies inside it. Until that recall is reached, rounds go on with longer
lists; links that the audit finds are added. Where rounds end before, or too few components have links to tell, every
two blocks of a label are compared, which is exact and takes time that grows with the square of a label's size.
Links are pairs at the threshold. Last, an exact check counts each class's links inside its component, block by
block: both ends of a link are in one component, so lists that were too short lose no link there.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have a null label
link with nothing and stand alone; only vectors of equal length link; ties and repeated rows share a class and
link with each other; rows with a null id get the smallest id of their component, null if there is none; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, components, drop, store, table

NEIGHBOURS, STARTS, BLOCK, CHECKED = 10, 6, 96, 1024
#: Classes audited first and at most, components that those with links come from, the recall to be reached, and rounds at most.
AUDITED, MOST_AUDITED, LINKED, RECALL, ROUNDS = 1024, 4096, 64, 0.995, 6


def _prepared(batches):
    import hashlib

    import numpy as np

    for batch in batches:
        label, vec, key = batch.column(1).to_pylist(), [], []
        for l, v in zip(label, batch.column(2).to_pylist(), strict=True):
            x = None if l is None or not v or any(c is None for c in v) else np.array(v, np.float64)
            ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
            if ok:  # the largest component between 0.5 and 1, so that no square is lost; a power of two changes no digit of the others
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
            vec.append(x.tobytes() if ok else None)
            key.append(hashlib.blake2b(f"{l}|".encode() + (x + 0.0).tobytes(), digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{l}|{len(v) if v else 0}" for l, v in zip(label, vec, strict=True)]), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "key", "vec"])


def _units(vecs):
    import numpy as np

    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(batches):
    """A block for each class in each start: its label, as many signs of projections as its label's size asks for."""
    import numpy as np

    planes = {}
    for batch in batches:
        out = []
        for label, key, vec, m in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            d = len(vec) // 8
            if d not in planes:
                planes[d] = np.random.default_rng(d).normal(size=(STARTS * 40, d))
            signs = (planes[d] @ np.frombuffer(vec, np.float64) > 0).reshape(STARTS, 40)
            bits = max(0, int(np.ceil(np.log2(max(1, m) / (BLOCK / 2)))))
            out += [(f"{label}|{s}|{signs[s, :bits].astype(int).tolist()}", key) for s in range(STARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["node", "key"])


def _grouped(batches):
    """Rows of each node, from rows sorted by node: node, key, vec, last, new."""
    node, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != node:
                if len(rows) > 1:
                    yield rows
                node, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _nearest(most: int, threshold: float):
    """Each key's nearest ones within its node, one of the two new there, if they link or reach the key's last."""

    def run(batches):
        import numpy as np

        src, dst, cos = [], [], []
        for rows in _grouped(batches):
            u, old = _units([r[2] for r in rows]), np.array([not r[4] for r in rows])
            c = u @ u.T
            np.fill_diagonal(c, -3)
            c[np.ix_(old, old)] = -3
            k = min(most, len(rows) - 1)
            top = np.argpartition(-c, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(c, top, axis=1)
            x, y = np.nonzero(near >= np.minimum([r[3] for r in rows], threshold)[:, None])
            src += [rows[i][1] for i in x.tolist()]
            dst += [rows[j][1] for j in top[x, y].tolist()]
            cos += near[x, y].tolist()
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary()), pa.array(cos, pa.float64())], names=["src", "dst", "cos"])
                src, dst, cos = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary()), pa.array(cos, pa.float64())], names=["src", "dst", "cos"])

    return run


def _in_nodes(rows: DataFrame, vectors: DataFrame, most: int, threshold: float) -> DataFrame:
    """Pairs of stored rows (node, key, new) in nodes of bounded size; larger ones are dealt by hash and wholly compared.

    Rows travel without vectors (key, vec, last) until their node is known."""
    n = store(rows.groupBy("node").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts")).where("parts > 1"), "large")
    cut = rows.join(n, "node", "left").withColumn("new", F.col("new") | F.col("parts").isNotNull())
    cut = cut.withColumn("node", F.when(F.col("parts") > 1, F.concat("node", F.lit("#"), F.expr("pmod(xxhash64(key, node), parts)").cast("string"))).otherwise(F.col("node")))
    dealt = cut.join(vectors, "key").select("node", "key", "vec", "last", "new")
    return dealt.repartition("node").sortWithinPartitions("node", "key").mapInArrow(_nearest(most, threshold), "src binary, dst binary, cos double")


def _best(pairs: DataFrame, most: int, threshold: float) -> DataFrame:
    """The nearest `most` of each src, or up to four times as many links, ranked; pairs: src, dst, cos, new."""
    both = pairs.union(pairs.select("dst", "src", "cos", "new")).groupBy("src", "dst").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    rank = both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cos"), "dst")))
    return rank.where((F.col("r") <= most) | ((F.col("cos") >= threshold) & (F.col("r") <= 4 * most)))


def _around(graph: DataFrame, fresh: bool) -> DataFrame:
    """node, key, new: each class with its neighbours and those it is a neighbour of; fresh: all are new.

    Otherwise classes whose neighbours are all old are left out."""
    pairs = graph.select(F.col("src").alias("at"), F.col("dst").alias("key"), "new").union(graph.select("dst", "src", "new")).union(graph.select("src", "src", F.lit(False)))
    rows = pairs.groupBy("at", "key").agg(F.min("new").alias("new"))
    if fresh:
        rows = rows.withColumn("new", F.lit(True))
    else:
        new = graph.where("new")
        rows = rows.join(new.select(F.col("src").alias("at")).union(new.select("dst")).distinct(), "at", "left_semi")
    return rows.select(F.hex("at").alias("node"), "key", "new")


def _audit(sample, threshold: float):
    """For each audited class, its links in a batch and how many lie in its component, and one link to each other component."""

    def run(batches):
        import numpy as np

        of: dict = {}
        for l, k, v, c in sample:
            of.setdefault(l, []).append((k, v, c))
        for batch in batches:
            a, b, n, good = [], [], [], []
            labels, keys, vecs, comps = (batch.column(i).to_pylist() for i in range(4))
            places: dict = {}
            for i, l in enumerate(labels):
                places.setdefault(l, []).append(i)
            for l, at in places.items():
                mine = of.get(l, [])
                if mine:  # block by block: a label may hold the whole batch and the whole sample
                    u = _units([m[1] for m in mine])
                    hit = np.concatenate([u @ _units([vecs[i] for i in at[j : j + 1024]]).T >= threshold for j in range(0, len(at), 1024)], axis=1)
                    for x in np.flatnonzero(hit.any(axis=1)).tolist():
                        found = [at[y] for y in np.flatnonzero(hit[x]).tolist() if keys[at[y]] != mine[x][0]]
                        other = {comps[i]: keys[i] for i in found if comps[i] != mine[x][2]}
                        if found:
                            a.append(mine[x][0]), b.append(None), n.append(len(found)), good.append(sum(comps[i] == mine[x][2] for i in found))
                        for k in other.values():
                            a.append(mine[x][0]), b.append(k), n.append(0), good.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(good, pa.int64())], names=["a", "b", "n", "good"])

    return run


def _placed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """label, key, vec, c: each class with its component, itself where it has no link."""
    return nodes.join(labels.withColumnRenamed("v", "key"), "key", "left").select("label", "key", "vec", F.coalesce("c", "key").alias("c"))


def audit(nodes: DataFrame, labels: DataFrame, threshold: float) -> tuple[float | None, DataFrame]:
    """(share of the audited classes' links that lie in their component, links between components that they have).

    Each class has one share, and each component the mean of its classes, so that a large one counts once. More
    classes are audited until those with links come from LINKED components; None if there are too few of them.
    """
    placed, most = store(_placed(nodes, labels), "placed"), AUDITED
    while True:
        sample = [(r.label, r.key, r.vec, r.c) for r in placed.orderBy(F.xxhash64("key"), "key").limit(most).collect()]  # MOST_AUDITED rows at most
        seen = store(placed.mapInArrow(_audit(sample, threshold), "a binary, b binary, n long, good long"), "audited")
        shares, of = {}, {k: c for _, k, _, c in sample}
        for r in seen.where("b IS NULL").groupBy("a").agg((F.sum("good") / F.sum("n")).alias("share")).collect():  # a row an audited class
            shares.setdefault(of[bytes(r.a)], []).append(r.share)
        everything = len(sample) < most
        if everything or len(shares) >= LINKED or most >= MOST_AUDITED:
            break
        most *= 4
    missed = seen.where("b IS NOT NULL").select("a", "b")
    if not everything and len(shares) < LINKED:
        return None, missed
    return (sum(sum(s) / len(s) for s in shares.values()) / len(shares) if shares else 1.0), missed


def _bridges(threshold: float):
    """Links of a node that join its components, one for each two joined."""

    def run(batches):
        import numpy as np

        def out(rows):
            u, side, names, pairs = _units([r[2] for r in rows]), np.array([r[4] for r in rows]), {}, []
            comp = np.array([names.setdefault(r[3], len(names)) for r in rows])
            mixed = side.min() != side.max()
            mine = np.flatnonzero(side == side.min())
            other = np.flatnonzero(side != side.min()) if mixed else mine
            hit = u[mine] @ u[other].T >= threshold
            for i, x in enumerate(mine.tolist()):
                for y in other[hit[i] & (comp[other] != comp[x])].tolist():
                    if comp[y] != comp[x]:
                        comp[comp == comp[y]] = comp[x]
                        pairs.append((rows[x][1], rows[y][1]))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

        node, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != node:
                    if len(rows) > 1:
                        yield out(rows)
                    node, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield out(rows)

    return run


def bridges(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join all components that any link joins; every two blocks of a label are compared."""
    rows = store(_placed(nodes, labels), "placed")
    size = store(rows.groupBy("label").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("blocks")), "sizes")
    cut = rows.join(size, "label").withColumn("block", F.expr("CAST(pmod(xxhash64(key, 5), blocks) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("node", F.concat_ws("|", "label", F.least("block", "other"), F.greatest("block", "other")))
    dealt = cut.select("node", "key", "vec", "c", F.col("block").alias("side")).repartition("node").sortWithinPartitions("node", "key")
    return store(dealt.mapInArrow(_bridges(threshold), "a binary, b binary").distinct(), "bridges")


def _checked(threshold: float):
    """Links of each key inside a node, its own half or against the other half, weighted by class sizes."""

    def run(batches):
        import numpy as np

        node, rows = None, []

        def out(rows):
            u, w, side = _units([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows])
            got = []
            mixed = side.min() != side.max()
            for s in sorted(set(side.tolist())):
                mine = np.flatnonzero(side == s)
                other = np.flatnonzero(side != s) if mixed else mine
                hit = u[mine] @ u[other].T >= threshold
                if not mixed:
                    np.fill_diagonal(hit, False)
                got += zip([rows[i][1] for i in mine], (hit @ w[other]).tolist(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64())], names=["key", "links"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != node:
                    if len(rows) > 1:
                        yield out(rows)
                    node, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield out(rows)

    return run


def exact_links(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """key, links: rows linked with a class, its own left out, counted in all of its component."""
    rows = nodes.join(labels.withColumnRenamed("v", "key"), "key").select("key", "vec", "n", "c")
    size = store(rows.groupBy("c").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("blocks")), "sizes")
    cut = rows.join(size, "c").withColumn("block", F.expr("CAST(pmod(xxhash64(key, 3), blocks) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("node", F.concat_ws("|", F.hex("c"), F.least("block", "other"), F.greatest("block", "other")))
    dealt = cut.select("node", "key", "vec", "n", F.col("block").alias("side")).repartition("node").sortWithinPartitions("node", "key")
    return dealt.mapInArrow(_checked(threshold), "key binary, links long").groupBy("key").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, label, embedding)."""
    rows = store(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_prepared, "vec_id long, label string, key binary, vec binary"), "vectors")
    nodes = store(rows.where("key IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"), F.max("vec").alias("vec"), F.count("*").alias("n")), "classes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("m"))
    starts = nodes.select("label", "key", "vec").join(store(sizes, "labels"), "label").select("label", "key", "vec", "m").mapInArrow(_codes, "node string, key binary")
    most, bare = NEIGHBOURS, nodes.select("key", "vec")
    first = store(_in_nodes(store(starts.withColumn("new", F.lit(True)), "starts"), bare.withColumn("last", F.lit(-2.0)), most // 2, threshold), "first")
    links = store(first.where(F.col("cos") >= threshold).select("src", "dst").distinct(), "links")
    graph = store(_best(first.withColumn("new", F.lit(True)), most, threshold), "graph")
    recall = None
    for round_ in range(ROUNDS):
        around = store(_around(graph, round_ != 1), "around")  # lists grow from the third round on, so old pairs may enter
        last = graph.where(F.col("r") == most).select(F.col("src").alias("key"), F.col("cos").alias("last"))
        vectors = bare.join(last, "key", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
        found = store(_in_nodes(around, vectors, most, threshold), "found")
        links = store(links.union(found.where(F.col("cos") >= threshold).select("src", "dst")).distinct(), "links")
        graph = store(_best(graph.select("src", "dst", "cos", F.lit(False).alias("new")).union(found.withColumn("new", F.lit(True))), most, threshold), "graph")
        labels = store(components(links), "components")
        if round_:
            recall, missed = audit(nodes, labels, threshold)
            if recall is None or recall >= RECALL:
                break
            links, most = store(links.union(missed).distinct(), "links"), 2 * most
    more = missed if recall is not None and recall >= RECALL else bridges(nodes, labels, threshold)
    if not more.isEmpty():
        labels = store(components(labels.select(F.col("v").alias("a"), F.col("c").alias("b")).union(more)), "components")
    exact = store(exact_links(nodes, labels, threshold), "exact")
    out = rows.where("key IS NOT NULL").join(nodes.select("key", "n"), "key").join(labels.withColumnRenamed("v", "key"), "key", "left").join(exact, "key", "left")
    out = store(out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "key").alias("comp")), "placed")
    least = store(out.groupBy("comp").agg(F.min("vec_id").alias("component_id")), "least")
    out = out.join(least, "comp").select("vec_id", "n_links", "component_id").union(rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(columns(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))
