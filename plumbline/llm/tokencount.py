"""Token counts from flat, unindexed token files.

Files hold token ids as little-endian uint16, an end-of-document id after each document, and nothing else. A
scan cuts files into blocks; in each block numpy finds the end ids at once. What lies between two ends of a block
is a document's count; a block's first document began in earlier blocks, so a prefix scan over the blocks' sums
gives each block the number of ends before it and the tokens since the last of them.

Defined results: null and empty texts have no tokens; a text of any length is written whole; repeated rows and ids
are documents of their own; null ids are kept; an empty table gives no rows; other columns are left out. Tokens
after a file's last end id belong to no finished document and aren't counted.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .shared import columns, small_batches, store, table, work_path

#: Tokens of a block.
BLOCK = 1 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, vocabulary: str, pattern: str, end: int) -> DataFrame:
    """Write docs (doc_id, text) to flat files under path; file, place, doc_id says which document stands where."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary file

    def run(batches):
        import numpy as np
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}, special_tokens={})
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        name, place = f"{root}/{uuid.uuid4().hex}.tokens", 0  # a task that runs again writes another file
        with fs.open_output_stream(name) as out:
            for whole in batches:
                for batch in slices(whole, 1):
                    for text in batch.column(1).to_pylist():
                        out.write(np.array([*coder.encode_ordinary(text or ""), end], "<u2").tobytes())
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(place, place + n), pa.int64()), batch.column(0)], names=["file", "place", "doc_id"])
                    place += n

    return store(docs.select("doc_id", "text").mapInArrow(run, "file string, place long, doc_id long"), "manifest")


def blocks(spark: SparkSession, path: str, files: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """file, block, size of every block, from the folder's listing; files: only these."""
    from pyarrow import fs as pfs

    fs, root = _fs(path)
    found = [(i.path, i.size // 2) for i in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".tokens")]
    listed = spark.createDataFrame(found, "file string, tokens long")
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    cut = listed.where("tokens > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))))
    return cut.select("file", "block", F.least(F.lit(block).cast("long"), F.col("tokens") - F.col("block") * block).alias("size"))


def count(plan: DataFrame, path: str, end: int, block: int = BLOCK) -> DataFrame:
    """file, place, n_tokens of each document in the blocks of plan."""

    def run(batches):
        import numpy as np

        fs, _ = _fs(path)
        for batch in batches:
            for file, b, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(file) as f:
                    f.seek(2 * block * b)
                    ends = np.flatnonzero(np.frombuffer(f.read(2 * size), "<u2") == end)
                n = np.diff(ends, prepend=-1) - 1
                tail = size if not len(ends) else size - 1 - int(ends[-1])
                yield pa.RecordBatch.from_arrays([pa.array([file] * (len(n) + 1)), pa.array([b] * (len(n) + 1), pa.int64()), pa.array(range(-1, len(n)), pa.int64()), pa.array([tail, *n.tolist()], pa.int64()), pa.array([len(n)] * (len(n) + 1), pa.int64())], names=["file", "block", "k", "n", "ends"])

    found = store(plan.repartition("file", "block").mapInArrow(run, "file string, block long, k long, n long, ends long"), "ends")
    order = Window.partitionBy("file").orderBy("block")
    sums = found.where("k = -1").withColumn("after", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(order))
    sums = sums.withColumn("since", F.sum("n").over(Window.partitionBy("file", "after").orderBy("block")))
    sums = sums.select("file", "block", (F.sum("ends").over(order) - F.col("ends")).alias("before"), F.coalesce(F.lag("since").over(order), F.lit(0)).alias("carry"))
    return found.where("k >= 0").join(store(sums, "sums"), ["file", "block"]).select("file", (F.col("before") + F.col("k")).alias("place"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = work_path(spark, "tokens")
    manifest = write(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256)
    counts = count(blocks(spark, path, manifest), path, 50256)
    return manifest.join(counts, ["file", "place"]).select("doc_id", "n_tokens")
