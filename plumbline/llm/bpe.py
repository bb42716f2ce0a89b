"""Byte-level BPE: recursive DuckDB queries merge each word's tokens; ordered aggregation puts bytes together again.

A text is cut into pieces by the tokenizer's pattern, each piece is encoded by itself. In a partition, the
distinct pieces of a batch that were not met before go to one recursive query: the state is a word's token ids,
each round lists its token positions, joins neighbouring positions with the merge table, and contracts the
leftmost pair of least rank in each word, until no word has a pair that merges; words that are done leave the
recursion. Decoding joins token positions with the vocabulary and aggregates the bytes in order.

A piece of more than `LONG` bytes goes to the query in blocks, which are then joined two by two. An encoding is
right if each two neighbouring tokens, taken alone, encode to themselves: the first merge across a border of such
tokens would be made in the pair alone as well. So where two blocks meet, the tokens around the border are encoded
again, more of them until the neighbours on both sides fit. The recursion stays short, whatever a piece's length.

Batches are Arrow throughout: a text is a run of codes of its distinct words, and its ids and bytes are the runs
that a take by those codes lays down one after the other.

Defined results: null text counts as empty (no ids, zero bytes); empty text gives no ids; a text of any length is
encoded whole; repeated rows and ids give repeated rows; an empty table gives an empty table with the same
columns; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import hashlib
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import columns, small_batches

#: Pieces that a worker keeps, in two generations: those met since the last change and those before. Bounds memory, not results.
KEPT, KEPT_BYTES = 150_000, 100
#: Words in one recursive query, and the sum of their squared lengths, which bounds the states of its rounds.
AT_ONCE, STATES = 10_000, 4_000_000
#: Bytes of a piece that goes to the recursion whole, of a block of a longer one, and tokens first encoded again on each side of a border.
LONG, BLOCK, REACH = 192, 64, 4
#: Bytes of text encoded at once.
SLICE = 4_200_000

MERGE = """
WITH RECURSIVE state(w, ids, n) AS (
  SELECT w, ids, len(ids) FROM start
  UNION ALL
  (WITH pairs AS (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS i FROM state),
        best AS (SELECT w, min((m.token::BIGINT << 32) | i) AS k FROM pairs JOIN merges m ON pairs.l = m.l AND pairs.r = m.r GROUP BY w)
   SELECT s.w, ids[:(k & 4294967295) - 1] || [(k >> 32)::INT] || ids[(k & 4294967295) + 2:], n - 1 FROM state s JOIN best ON s.w = best.w))
SELECT w, arg_min(ids, n) AS ids FROM state GROUP BY w ORDER BY w
"""
#: The same for long words: all places of the least pair at once, from the left; where they overlap, every second one.
MERGE_ALL = """
WITH RECURSIVE state(w, ids, n) AS (
  SELECT w, ids, len(ids) FROM start
  UNION ALL
  (WITH places AS (SELECT w, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM state),
        pairs AS (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY i) AS r FROM places),
        least AS (SELECT pairs.*, m.token, min(m.token) OVER (PARTITION BY w) AS best FROM pairs LEFT JOIN merges m ON pairs.t = m.l AND pairs.r = m.r),
        hits AS (SELECT *, coalesce(token = best, false) AS hit FROM least WHERE best IS NOT NULL),
        runs AS (SELECT *, i - sum(hit::INT) OVER (PARTITION BY w ORDER BY i) AS run FROM hits),
        taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, run, hit ORDER BY i) % 2 = 1 AS take FROM runs),
        left_ AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY i) AS gone FROM taken)
   SELECT w, list(CASE WHEN take THEN token ELSE t END ORDER BY i), count(*) FROM left_ WHERE NOT gone GROUP BY w))
SELECT w, arg_min(ids, n) AS ids FROM state GROUP BY w ORDER BY w
"""
DECODE = """
WITH positions AS (SELECT w, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM coded)
SELECT w, unhex(string_agg(hex, '' ORDER BY i)) AS bytes FROM positions JOIN vocab USING (token) GROUP BY w
"""
#: Marks that are pieces of their own behind a word.
MARKS = (".", ",", ";", ":", "!", "?")
#: A place where a cut before a space or line end may part white space that the pattern takes as one.
ODD = r"[S][ \n](?:[S]|\z)".replace("S", r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _runs(array) -> tuple:
    """The data of a binary or list array, and where each element begins in it, the end last."""
    import numpy as np

    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return (array.values if pa.types.is_list(array.type) else memoryview(array.buffers()[2] or b"")), at


class Codec:
    """Encodes and decodes in one Python worker. ranks: a vocabulary's tokens, all 256 bytes among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_to_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = {r: b for b, r in ranks.items()}
        self.decimals = pa.array([b" %d" % i for i in range(max(self.token) + 1)], pa.binary())
        splits = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.ordered = all(max(l, r) < t for l, r, t in splits)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": ""})
        self._put("merge_rows", l=pa.array([s[0] for s in splits], pa.int32()), r=pa.array([s[1] for s in splits], pa.int32()), token=pa.array([s[2] for s in splits], pa.int32()))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self._put("vocab_rows", token=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([b.hex() for b in ranks]))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _put(self, name: str, **cols) -> None:
        self.db.register(name, pa.table(cols))

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, shortest first, int32 after int32, by the recursion."""
        import numpy as np

        out: list[bytes] = []
        at = 0
        while at < len(words):
            end, states = at, 0
            while end < len(words) and (end == at or end - at < AT_ONCE and states + len(words[end]) ** 2 <= STATES):
                states += len(words[end]) ** 2
                end += 1
            part = words[at:end]
            ids = self.bytes_to_id[np.frombuffer(b"".join(part), np.uint8)]
            ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
            self._put("start", w=pa.array(range(len(part)), pa.int32()), ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            got = self.db.sql(MERGE_ALL if self.ordered and len(part[-1]) > LONG else MERGE).to_arrow_table().column("ids").combine_chunks()
            flat, places = _runs(got)
            flat, places = flat.to_numpy().astype(np.int32, copy=False).tobytes(), (4 * places.astype(np.int64)).tolist()
            out += [flat[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            at = end
        return out

    def _distinct(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = sorted(set(words), key=len)
        return dict(zip(found, self._contracted(found), strict=True))

    def _spelled(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words: of blocks, joined two by two."""
        import numpy as np

        blocks = [[w[i : i + BLOCK] for i in range(0, len(w), BLOCK)] for w in words]
        known = self._distinct([b for bs in blocks for b in bs])
        parts = [[memoryview(known[b]).cast("i").tolist() for b in bs] for bs in blocks]
        while any(len(p) > 1 for p in parts):
            borders = [(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]
            joined = self._bordered(borders)
            parts = [[next(joined) for _ in range(0, len(p) - 1, 2)] + p[len(p) - len(p) % 2 :] for p in parts]
        return [np.array(p[0], "<i4").tobytes() for p in parts]

    def _bordered(self, borders: list[tuple[list[int], list[int]]]):
        """The encoding of each two neighbours as one."""
        out: list = [None] * len(borders)
        open_, reach = list(range(len(borders))), REACH
        while open_:
            zones = {i: self._spelled(borders[i][0][-reach:]) + self._spelled(borders[i][1][:reach]) for i in open_}
            known = self._distinct(list(zones.values()))
            tried, sides = {}, {}
            for i in open_:
                left, right = borders[i]
                zone = memoryview(known[zones[i]]).cast("i").tolist()
                before, after = left[:-reach], right[reach:]
                tried[i] = before + zone + after
                sides[i] = [x for x in ((before[-1], zone[0]) if before else None, (zone[-1], after[0]) if after else None) if x]
            pairs = {x: self._spelled(x) for xs in sides.values() for x in xs}
            known = self._distinct(list(pairs.values()))
            fits = {x: memoryview(known[b]).cast("i").tolist() == list(x) for x, b in pairs.items()}
            for i in open_:
                if all(fits[x] for x in sides[i]):
                    out[i] = tried[i]
            open_, reach = [i for i in open_ if out[i] is None], 4 * reach
        return iter(out)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are no tokens themselves, int32 after int32."""
        short = [w for w in words if len(w) <= LONG]
        done = self._distinct(short)
        rest = list({w for w in words if len(w) > LONG})
        done.update(zip(rest, self._long(rest), strict=True))
        return [done[w] for w in words]

    def decode(self, coded: pa.Array) -> list[bytes | None]:
        """Bytes of each list of ids; null stays null."""
        self._put("coded", w=pa.array(range(len(coded)), pa.int32()), ids=coded)
        got = self.db.sql(DECODE).to_arrow_table()
        out: list = [None if x else b"" for x in coded.is_null().to_pylist()]
        for w, b in zip(got.column("w").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[w] = b
        return out

    def pieces(self, chunk: str) -> list[bytes]:
        """The pattern's matches in a chunk; words, alone or with a mark behind or a line end before them, are cut without it."""
        word = chunk[1:] if chunk[:1] in (" ", "\n") else chunk
        if word.isalpha():
            return [b"\n", word.encode()] if chunk[0] == "\n" else [chunk.encode()]
        if word[-1:] in MARKS and word[:-1].isalpha() and chunk[0] != "\n":
            return [chunk[:-1].encode(), chunk[-1:].encode()]
        return [p.encode() for p in self.pattern.findall(chunk)]

    def learned(self, pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """For each piece its ids, int32 after int32, and the bytes that they decode to.

        Those of new pieces come from the two queries. Ids that did not decode to their piece would be an error, so
        of a known piece only the ids are kept.
        """
        import numpy as np

        known = [self.new.get(p) or self.old.get(p) for p in pieces]
        unknown = [p for p, x in zip(pieces, known, strict=True) if x is None]
        whole = [p for p in unknown if p in self.ranks]
        words = [p for p in unknown if p not in self.ranks]
        ids = [self.ranks[p].to_bytes(4, "little") for p in whole] + self.merge(words)
        flat, ends = np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *map(len, ids)]) // 4
        back = self.decode(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32())))
        got = dict(zip(whole + words, ids, strict=True))
        decoded = dict(zip(whole + words, back, strict=True))
        if any(p != x for p, x in decoded.items()):
            raise ValueError("a piece does not decode to its bytes: the vocabulary is not one of byte-level BPE")
        known = [x or got[p] for p, x in zip(pieces, known, strict=True)]
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        self.new.update([(p, x) for p, x in zip(pieces, known, strict=True) if len(p) <= KEPT_BYTES])
        return known, [decoded.get(p, p) for p in pieces]

    def coded(self, texts: pa.Array) -> tuple:
        """(pieces, codes, ends, order): text order[i] consists of the pieces that codes[ends[i]:ends[i + 1]] number."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        found = parts.flatten().dictionary_encode()
        codes, words = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        first, place = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(words) + place
        inside = np.zeros(len(words) + len(first), bool)
        inside[codes] = True
        numbers: dict[bytes, int] = {}
        chunks = [self.pieces(w if w[:1] == "\n" else " " + w) if x else () for w, x in zip(words, inside.tolist())]
        chunks += [self.pieces(words[i]) if words[i] else () for i in first.tolist()]
        cut = [numbers.setdefault(p, len(numbers)) for ps in chunks for p in ps]
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, chunks)]).astype(np.int32)), pa.array(cut, pa.int64()))
        spread = each.take(pa.array(codes))
        ends = _runs(spread)[1][ends].astype(np.int64)
        codes = spread.flatten().to_numpy(zero_copy_only=False)
        if odd.any():
            rest = [[numbers.setdefault(p.encode(), len(numbers)) for p in self.pattern.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
            codes = np.concatenate([codes, np.array([x for xs in rest for x in xs], np.int64)])
            ends = np.concatenate([ends, ends[-1] + np.cumsum([len(xs) for xs in rest])])
        return list(numbers), codes, ends, np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])

    def encode(self, texts: pa.Array, ids: bool = True, digests: bool = False) -> dict[str, pa.Array]:
        """n_tokens, ids, ids_sha256, decoded_sha256 of each text, as asked for."""
        import numpy as np
        import pyarrow.compute as pc

        pieces, codes, ends, order = self.coded(texts)
        known, decoded = self.learned(pieces)
        codes = pa.array(codes)

        def laid(runs):
            """The texts' runs, laid down one after the other, and where each text begins in them."""
            data, at = _runs(pc.take(runs, codes))
            return data, at[ends]

        back = np.argsort(order)
        coded = pa.array(known, pa.binary())
        data, at = laid(coded)
        out = {"n_tokens": pa.array((np.diff(at) // 4)[back].astype(np.int64))}
        if ids:
            lists = pa.ListArray.from_arrays(pa.array((at // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<i4", int(at[-1]) // 4)))
            out["ids"] = lists.take(pa.array(back))
        if digests:
            inner, inner_ends = _runs(coded)
            data, spelled = _runs(pc.take(self.decimals, pa.array(np.frombuffer(inner, "<i4", int(inner_ends[-1]) // 4))))
            decimal = pa.BinaryArray.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(spelled[inner_ends // 4].tobytes()), pa.py_buffer(data)])
            for name, runs, skip in (("ids_sha256", decimal, 1), ("decoded_sha256", pa.array(decoded, pa.binary()), 0)):  # no space before the first id
                data, at = laid(runs)
                found = [hashlib.sha256(data[a + skip : b] if b > a else b"").hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out[name] = pa.array([found[i] for i in back.tolist()], pa.string())
        return out


@contextlib.contextmanager
def _few_objects():
    """No search for cycles while many small objects, none of them in a cycle, come and go; freed memory goes back after."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


_codecs: dict[int, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (hash(ranks.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary file


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in added} | added
    return pa.RecordBatch.from_arrays(list(keep.values()), names=list(keep))


def _schema(df: DataFrame, **added) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in added] + [T.StructField(n, k) for n, k in added.items()])


def slices(batch: pa.RecordBatch, at: int, most: int = 8_000_000):
    """A batch in parts whose texts take about so many bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """df with n_tokens long and, as asked for, ids array<int> and ids_sha256, decoded_sha256 string."""
    small_batches(df.sparkSession, size="4m")
    ranks = _vocabulary(df, vocabulary)
    added = {"n_tokens": T.LongType()} | ({"ids": T.ArrayType(T.IntegerType())} if ids else {}) | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {})

    def run(batches):
        codec = _codec(ranks, pattern)
        for whole in batches:
            at = whole.schema.names.index(text)
            for batch in slices(whole, at, SLICE):
                with _few_objects():
                    got = codec.encode(batch.column(at), ids, digests)
                yield _with(batch, got)
        codec.old = {}  # a worker that goes on to other work keeps one generation at most

    return df.mapInArrow(run, _schema(df, **added))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded binary: the tokens' bytes in order; null ids give null, an id outside the vocabulary adds nothing."""
    small_batches(df.sparkSession)
    ranks = _vocabulary(df, vocabulary)

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            at = batch.schema.names.index(ids)
            yield _with(batch, {"decoded": pa.array(codec.decode(batch.column(at)), pa.binary())})

    return df.mapInArrow(run, _schema(df, decoded=T.BinaryType()))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .shared import table

    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
