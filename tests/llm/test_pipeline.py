"""The stages in turn over small documents, each against brute force on its own input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from estate.llm import packing, registry, secrets
from tools.check import compare, duck

from .conftest import make, prose
from .test_native import brute_counts, brute_lines, check_packing
from .test_python import brute_components, changed

SF = "/root/testdata/sf0.001"
SECRET = "token = 0123456789abcdef0123"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    clean = [prose(i, rng.randrange(25, 90), 600) for i in range(120)]
    texts = [f"a common line on top\n{t}\nown line {i}" for i, t in enumerate(clean)]
    texts += [changed(texts[i], 0.01, rng) for i in range(20)] + texts[:5]
    texts += [" ".join(w + "!!" for w in t.upper().split()) for t in clean[:15]]
    texts += ["short", "", None, "again and again it goes on " * 30, texts[30] + "\n" + SECRET, prose(77, 5000)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = make(spark, texts, sources=("s0", "s0", "s1")).withColumn("kept", F.lit("own column"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def test_every_stage_matches_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.orderBy("doc_id").collect()]
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == columns
            out.write.parquet(f"{corpus}/{name}")
            docs = spark.read.parquet(f"{corpus}/{name}")
            steps[name] = (before, [r.asDict() for r in docs.orderBy("doc_id").collect()])
        else:
            steps[name] = (before, out.collect())

    before, after = steps["quality_rules"]
    left = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before[:145]} <= left  # clean documents stay
    assert not {r["doc_id"] for r in before[145:160]} & left  # shouting goes
    for r in before:
        n = brute_counts(r["text"])
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            assert r["doc_id"] not in left
    assert all(r == next(b for b in before if b["doc_id"] == r["doc_id"]) for r in after)

    before, after = steps["line_dedup"]
    assert [r["text"] for r in after] == brute_lines([(r["source"], r["text"]) for r in before], 0.1, 5)
    assert "a common line on top" not in after[0]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = steps["near_duplicates"]
    want = [k for k, _, _, kept in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80) if kept]
    assert [r["doc_id"] for r in after] == sorted(want)

    before, after = steps["secret_scan"]
    assert [r["text"] for r in after] == [secrets.redacted(r["text"], secrets.find_all(r["text"])[1]) for r in before]
    assert not any(SECRET in r["text"] for r in after)

    before, after = steps["packing"]
    counts = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    check_packing(after, counts, packing.MAX_LENGTH, packing.BATCH_TOKENS)

    got = Counter(map(tuple, corpus_pipeline.run(spark, corpus).collect()))
    assert got == Counter(map(tuple, after))


def test_stages_handle_awkward_and_no_rows(spark, awkward, nothing, corpus):
    df, _ = awkward
    for docs in (df, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, corpus)
            assert name == "packing" or out.columns == columns
            # Each stage takes the awkward rows themselves, not what the one before left.
            out.collect()


def test_rows_of_one_key_share_their_fate(spark, docs, corpus):
    rows = docs([prose(1, 40)] * 3).withColumn("doc_id", F.lit(7).cast("bigint"))
    assert corpus_pipeline.near_duplicates(spark, rows, corpus).count() == 1


def test_one_row_of_a_group_stays(spark, corpus):
    same, other = prose(1, 40), prose(2, 40)
    rows = [(7, same), (7, same), (7, same), (7, other), (3, other), (None, same), (None, prose(3, 40)), (None, prose(3, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, corpus).collect()
    assert Counter(map(tuple, got)) == Counter([(7, same), (3, other), (None, prose(3, 40))])


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_operators_match_sql(spark, name):
    ok, note = compare(registry.QUERIES[name](spark, SF), duck(SF), registry.ORACLE[name])
    assert ok and "TYPES" not in note, note


def test_native_operators_have_no_python(spark):
    for name in ("op5_quality_rules", "op7_exact_dedup", "op8_line_dedup"):
        text = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        for bad in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "NestedLoopJoin"):
            assert bad not in text, (name, bad)
