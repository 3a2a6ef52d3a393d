"""The corpus pipeline: every stage against brute force on what its predecessor kept, and odd tables through all stages."""

import os
import shutil

import pytest

from .test_ops import ODD, SCHEMA, brute_blocks, brute_contamination, brute_groups, brute_padding, edited, prose, remaining

corpus_pipeline = pytest.importorskip("corpus_pipeline")
quality = pytest.importorskip("tessera.llm.quality")
SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    os.makedirs(tmp_path / "documents.parquet")
    return str(tmp_path)


def tables(spark):
    """Documents of the smallest tables and odd ones: nulls, empty, repeated rows, copies, shared lines, benchmark passages."""
    import random

    r = random.Random(30)
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    long = max((d[1] for d in docs[:60] if d[1]), key=len)
    more = [*ODD, *[edited(d[1], 2, r) for d in docs[:12] if d[1] and len(d[1].split()) > 60], *items, prose(3) + "\n" + long + "\n" + prose(4)]
    docs += [(10_000 + i, t, None if i % 3 else "en", "s", len(t or "")) for i, t in enumerate(more)]
    return [*docs, docs[3], (None, "a null identifier", "en", "s", 17), (None, None, None, None, None)]


def test_stages_against_brute_force(spark, folder):
    docs = spark.createDataFrame(tables(spark), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]

    def step(name, rows):
        df = spark.createDataFrame(rows, SCHEMA)
        out = stages[name](spark, df, folder)
        return sorted(map(tuple, out.collect()), key=lambda x: (x[0] is None, x[0], str(x)))

    rows = sorted(map(tuple, docs.collect()), key=lambda x: (x[0] is None, x[0], str(x)))
    assert len(step("quality_classifier", rows)) > 0.9 * len(rows)  # too few labels to tell much
    sf = "/root/testdata/sf0.01"
    some = spark.read.parquet(f"{sf}/documents.parquet").select(*[f.split()[0] for f in SCHEMA.split(", ")])
    some = some.unionByName(docs.where("doc_id >= 10000 or doc_id is null"))
    model = quality.train(some, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = {(r.id, r.kept) for r in quality.score(some, model).collect() if r.id is not None}
    kept = stages["quality_classifier"](spark, some, sf).collect()
    ids = {r.doc_id for r in kept if r.doc_id is not None}
    assert ids == {i for i, k in keep if k} and {i for i, k in keep if not k}.isdisjoint(ids) and len(ids) < len(keep)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in some.collect()}

    # Line dedup: identifiers are in order and rows of one identifier equal, so places are documents.
    unique = list(dict.fromkeys(rows))
    gone = brute_blocks([x[1] for x in unique])
    want = []
    for x in rows:
        lost = gone.get(unique.index(x))
        text = remaining(x[1], lost) if lost else x[1]
        if not lost or text.strip():
            want.append((x[0], text, *x[2:4], len(text) if lost else x[4]))
    got = step("line_dedup", rows)
    assert got == sorted(want, key=lambda x: (x[0] is None, x[0], str(x))) and any(gone.values())

    rows = got
    known = [x for x in dict.fromkeys(rows) if x[0] is not None]
    groups = brute_groups([x[1] for x in known], 80)
    lost = {x[0] for i, (x, (_, c)) in enumerate(zip(known, groups)) if i != c}
    got = step("near_dedup", rows)
    assert got == [x for x in rows if x[0] not in lost] and lost

    rows = got
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {d for d, v in brute_contamination([(i, x[1]) for i, x in enumerate(rows)], items).items() if v[1]}
    got = step("decontamination", rows)
    assert got == [x for i, x in enumerate(rows) if i not in dirty] and dirty

    packed = stages["packing"](spark, spark.createDataFrame(got, SCHEMA), folder).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(x[0]) for x in got)
    lengths = sorted(len((x[1] or "").split()) for x in got)
    assert sorted(r.n_tokens for r in packed) == lengths and all(r.padding == r.bucket_tokens - r.n_tokens >= 0 for r in packed)
    few = spark.createDataFrame(got[:40], SCHEMA)
    from tessera.llm import packing

    assert sum(r.padding for r in packing.pack(few, buckets=3).collect()) == brute_padding([len((x[1] or "").split()) for x in got[:40]], 3)


def test_run_and_odd_tables(spark, folder):
    """Whole runs: what run() returns is what its stages return, extra columns pass, an empty table stays empty."""
    docs = spark.createDataFrame(tables(spark), SCHEMA).selectExpr("*", "doc_id id", "text t", "1 gone", "'x' first", "2 grade", "true kept", "0 n", "3 row")
    path = f"{folder}/documents.parquet"
    docs.coalesce(3).write.mode("overwrite").parquet(path)
    fixed = ["doc_id", "n_tokens", "bucket", "bucket_tokens", "padding"]  # batches of equal lengths follow row numbers
    got = sorted(map(str, corpus_pipeline.run(spark, folder).select(*fixed).collect()))
    rows = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        columns, rows = rows.columns, stage(spark, rows, folder)
        assert name == "packing" or rows.columns == columns
    assert sorted(map(str, rows.select(*fixed).collect())) == got and len(got) > 100
    docs.limit(0).write.mode("overwrite").parquet(f"{folder}/empty.parquet")
    shutil.rmtree(path)
    os.rename(f"{folder}/empty.parquet", path)
    assert corpus_pipeline.run(spark, folder).count() == 0
