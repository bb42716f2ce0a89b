"""The pipeline as it runs, each stage against brute force on its own input; nulls, copies, long texts, clashing names, empty tables."""

import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import bpe, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string"
VALUE = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def run(spark, monkeypatch, rows, labels, folder):
    """Rows that each stage got, and those of the result."""
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen = []

    def watched(stage):
        def call(spark, docs, sf_dir):
            seen.append(docs)
            return stage(spark, docs, sf_dir)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(folder))
    assert all(d.columns == seen[0].columns for d in seen)
    return [[r.asDict() for r in d.collect()] for d in [*seen, out]]


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def ordered(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.fixture
def corpus():
    r = random.Random(12)
    words = [f"mot{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    texts = [" ".join(r.choices(words, k=30) + (["scumbag"] if i % 5 == 0 else [])) for i in range(300)]
    toxic = [int(i % 5 == 0) for i in range(300)]
    texts += [texts[1], texts[2].upper(), texts[3] + " more", " ".join(texts[4].split()[:15] + ["cut"] + texts[4].split()[15:]), None, None, "", " \n", "one two", "one two", " ".join(r.choices(words, k=20)) + f' token = "{VALUE}" end', " ".join(r.choices(words, k=40_000))]
    toxic += [0] * (len(texts) - 300)
    rows = [(i if i != 299 else None, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", None) for i, t in enumerate(texts)]
    rows.append(rows[11])
    return rows, [(i, 1, toxic[i]) for i in range(len(texts))] + [(None, None, 1), (12, 1, None)]


def test_each_stage_equals_brute_force(spark, monkeypatch, tmp_path, corpus):
    docs, clean, single, masked, mixed, out = run(spark, monkeypatch, *corpus, tmp_path)
    assert len(docs) == len(corpus[0])
    assert ordered(clean) == ordered(d for d in docs if "scumbag" not in (d["text"] or ""))

    shingles = [sets(d["text"]) for d in clean]
    group = list(range(len(clean)))
    for i, a in enumerate(shingles):
        for j in range(i):
            if a and 100 * len(a & shingles[j]) >= 80 * len(a | shingles[j]):
                group = [group[j] if g == group[i] else g for g in group]
    left = ordered(clean)
    for row in ordered(single):
        left.remove(row)  # no row is changed or added
    names = {}
    for d, g in zip(clean, group, strict=True):
        names.setdefault(repr(sorted(d.items())), g)
    assert sorted(names[row] for row in set(ordered(single))) == sorted(set(names.values())) and len(single) == len(set(group))
    assert len(single) < len(clean) - 4

    want = [d | {"text": d["text"] and d["text"].replace(VALUE, "[SECRET]")} for d in single]
    assert ordered(masked) == ordered(d | {"n_chars": None if d["text"] is None else len(d["text"])} for d in want)
    assert any("[SECRET]" in (d["text"] or "") for d in masked)

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d["doc_id"], d["text"], d["source"]) for d in masked])
    times = {i: -(-taken // size) if size else int(target) // whole for i, size, whole, target, taken in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP9_SQL})").fetchall()}
    assert len(times) == len(masked)
    assert ordered(mixed) == ordered(d for d in masked for _ in range(times[d["doc_id"]]))

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d in mixed:
        ids = enc.encode_ordinary(d["text"] or "")
        want.append({"doc_id": d["doc_id"], "source": d["source"], "n_tokens": len(ids), "ids": ids, "ids_sha256": sha(" ".join(map(str, ids)).encode()), "decoded_sha256": sha((d["text"] or "").encode())})
    assert ordered(out) == ordered(want)


def test_empty_tables(spark, monkeypatch, tmp_path):
    assert run(spark, monkeypatch, [], [], tmp_path) == [[]] * 6
