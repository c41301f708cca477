"""Ranking, totals, predicates and paging on hand-sized frames."""

import pytest
from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.functions import text as T
from estate.operators import storage as S
from estate.plans.shapes import hot_join, top_k

REL = ("target string, schema_name string, relation_name string, relkind string, owner string, "
       "row_estimate bigint, size_bytes bigint")


def rel(frame, *items):
    return frame([(t, s, n, k, "o", r, z) for t, s, n, k, r, z in items], REL)


def test_prefix_underscore_is_a_letter(frame, rows):
    df = frame([("dev_a",), ("devx",), ("deva",), ("de%v",)], "schema_name string")
    assert rows(P.with_prefix(df, "schema_name", "dev_")) == [("dev_a",)]
    assert rows(P.with_prefix(df, "schema_name", ["de%", "dev_, dev_"])) == [("de%v",), ("dev_a",)]
    assert P.with_prefix(df, "schema_name", []).count() == 4


def test_glob_and_suffix(frame, rows):
    df = frame([("a_b",), ("axb",), ("a#b",), ("x_deprecated",), ("xdeprecated",)], "n string")
    assert rows(df.where(P.glob("n", "a_*"))) == [("a_b",)]
    assert rows(df.where(P.glob("n", "a#*"))) == [("a#b",)]
    assert rows(P.with_suffix(df, "n", "_deprecated")) == [("x_deprecated",)]


def test_system_and_protected(frame, rows):
    df = frame([("pg_catalog",), ("pgx",), ("information_schema",), ("PUBLIC",), ("app",)], "schema_name string")
    assert rows(P.hide_system(df)) == [("PUBLIC",), ("app",), ("pgx",)]
    assert rows(df.where(P.is_protected())) == [("PUBLIC",), ("information_schema",), ("pg_catalog",)]


def test_exclusion_tokens(frame, rows, spark):
    df = frame([("raw", "a"), ("app", "b"), ("app", "c")], "schema_name string, relation_name string")
    assert rows(P.exclude(df, ["raw # staging", "", "# note", "app.b"])) == [("app", "c")]
    tokens = frame([("raw # staging",), ("",), ("app . b",), ("a.b.c",)], "token string")
    assert rows(P.exclude(df, tokens)) == [("app", "c")]
    with pytest.raises(ValueError):
        P.exclude(df, ["a.b.c"])


def test_unknown_sizes_stay_unknown(frame, rows):
    df = rel(frame, ("w", "dev_a", "x", "r", -1, None), ("w", "dev_a", "y", "r", 5, None))
    top = S.top_relations(df, "dev_", 5)
    assert rows(top, "relation_name", "row_estimate", "size_bytes") == [("x", None, None), ("y", 5, None)]
    summary = S.storage_summary(df, "dev_", 1).first()
    assert (summary.matched_bytes, summary.pct_of_disk, summary.remaining) == (None, None, 1)


def test_no_match_keeps_disk_total(frame):
    row = S.storage_summary(rel(frame, ("w", "prod", "x", "r", 1, 100)), "dev_", 5).first()
    assert (row.matched_bytes, row.matched_count, row.disk_bytes, row.pct_of_disk) == (0, 0, 100, 0.0)


def test_rank_by_rows_where_sizeless(frame, rows):
    df = rel(frame, ("d", "a", "x", "r", 1, None), ("d", "a", "y", "r", 9, None), ("p", "a", "z", "v", 9, 9))
    got = rows(S.top_relations(df, (), 5, ["d"]), "relation_name", "rank", "ranked_by")
    assert got == [("x", 2, "rows"), ("y", 1, "rows")]


def test_drop_plan_quotes(frame):
    df = rel(frame, ("w", 'a"b', "m", "m", 1, 50), ("w", "a", "t", "p", 1, 150))
    plan = S.drop_plan(S.top_relations(df, (), 5), S.storage_summary(df, (), 5)).orderBy("rank").collect()
    assert plan[1].statement == 'DROP MATERIALIZED VIEW "a""b"."m";'
    assert (plan[0].statement, plan[0].pct_of_disk) == ('DROP TABLE "a"."t";', 75.0)


def test_top_k_beyond_the_pruning_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id"))
    got = top_k(df, ["k"], [F.col("id").desc()], 1500)
    assert got.count() == 3000
    assert got.groupBy("k").agg(F.min("id"), F.max("rank")).orderBy("k").collect()[0][1:] == (2000, 1500)


def test_hot_join_equals_plain_join(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(0, 50, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    big = big.withColumn("k", F.col("k").cast("int"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, hot_join(big, small, ["k"], how).select("id").collect()))
        b = sorted(map(tuple, big.join(small, "k", how).select("id").collect()))
        assert a == b, how


def test_hot_join_repeats_only_what_is_not_broadcast(spark):
    big = spark.range(4000).select((F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plan = lambda: hot_join(big, small, ["k"], "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Generate" in plan()
        assert hot_join(big, small, ["k"], "left").count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_cover_everything_once(spark):
    df = spark.range(10)
    seen = []
    for number in (1, 2, 3):
        page = S.page(df, ["id"], 4, number).collect()
        seen += [r.id for r in page]
        assert all(r.has_more == (number < 3) for r in page)
    assert seen == list(range(10))
    page = S.page_after(df, "id", 5, 4).collect()
    assert [r.id for r in page] == [6, 7, 8, 9] and not page[0].has_more
    assert S.page(df, ["id"], 0).count() == 10
    with pytest.raises(ValueError):
        S.page(df, [], 4)


def test_any_page_of_ranked_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") % 3).alias("k"),
                                  F.when(F.col("id") % 2 == 0, "x").alias("s"))
    pages = S.Pages(df, [F.col("id").desc()])
    assert pages.total == 5000
    for number, limit in ((1, 7), (100, 50), (33, 150), (34, 150), (5000, 1), (5001, 1), (1, 6000)):
        got = pages.page(number, limit).collect()
        want = list(range(4999, -1, -1))[(number - 1) * limit : number * limit]
        assert sorted((r.id for r in got), reverse=True) == want
        assert all(r.has_more == (number * limit < 5000) for r in got)
    assert set(pages.page(1, 3).columns) == {"id", "k", "s", "has_more"}
    with pytest.raises(ValueError):
        S.Pages(df, [])
    with pytest.raises(ValueError):
        pages.page(0, 5)


def test_deep_pages_hold_a_frequent_key_and_nulls_in_order(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.lit("same")).otherwise(
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("k"), F.col("id")))).alias("key"))
    pages = S.Pages(df, ["key"])
    # Ties are spread over tasks by a hash of the row: no range holds them all.
    assert max(rows for _, rows in pages.ranges) < 1200
    seen = [r for n in range(1, 31) for r in pages.page(n, 100).collect()]
    assert sorted(r.id for r in seen) == list(range(3000))
    blocks = [[r.key for r in pages.page(n, 500).collect()] for n in range(1, 7)]
    flat = [k for b in blocks for k in sorted(b, key=lambda k: (k is not None, k or ""))]
    assert flat == sorted(flat, key=lambda k: (k is not None, k or ""))


def test_pages_behind_the_shallow_ones_agree_with_sorting(spark):
    df = spark.range(30_000).select((F.col("id") * 7 % 30_000).alias("id"))
    got = S.page(df, ["id"], 100, 200).collect()
    assert sorted(r.id for r in got) == list(range(19_900, 20_000)) and got[0].has_more
    assert S.page(df, ["id"], 100, 400).count() == 0
    assert S.Pages(df.where("id < 0"), ["id"]).page(1, 5).count() == 0


def test_cap_reads_its_input_once(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 7 % 3).alias("k"), "id").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out = S.cap(df, ["k"], [F.col("id").desc()], 5)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for k in range(3):
        got = out.where(f"k = {k}").orderBy("rank").collect()
        ids = sorted((i for i in range(2000) if i % 7 % 3 == k), reverse=True)
        assert [r.id for r in got] == ids[:5] and {r.hidden for r in got} == {len(ids) - 5}
    assert S.cap(df, ["k"], ["id"], 0).count() == 0
    assert {r.hidden for r in S.cap(df, ["k"], ["id"], 1500).collect()} == {0}


def test_cap_reports_hidden(frame, rows):
    df = frame([("a", i) for i in range(5)] + [("b", 1)], "k string, v int")
    assert rows(S.cap(df, ["k"], ["v"], 2), "k", "v", "hidden") == [("a", 0, 3), ("a", 1, 3), ("b", 1, 0)]


@pytest.mark.parametrize("size,text", [
    (None, "—"), (-1, "—"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536 * 1024, "1.5 MiB"),
    (5 * 1024**4, "5.0 TiB"), (2048 * 1024**4, "2.0 PiB"),
])
def test_fmt_size(frame, size, text):
    assert frame([(size,)], "n bigint").select(T.fmt_size("n")).first()[0] == text


def test_fmt_rows(frame):
    got = frame([(1234567,), (-1,), (None,)], "n bigint").select(T.fmt_rows("n").alias("t")).collect()
    assert [r.t for r in got] == ["1,234,567", "—", "—"]


def test_member_filter_loses_no_wanted_row_and_few_others_pass(spark):
    from estate.plans.shapes import member_filter, split_members

    keys = spark.range(0, 100_000, 37).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(100_000).select("id", F.concat(F.lit("k"), "id").alias("name"), F.repeat(F.lit("x"), 50).alias("wide"))
    got = member_filter(rows, "name", keys)
    assert got.columns == rows.columns
    ids = {r.id for r in got.select("id").collect()}
    assert set(range(0, 100_000, 37)) <= ids and len(ids) < 2 * 100_000 / 37
    # A full bitmap lets all through, and no keys let none through.
    assert member_filter(rows, "name", rows.select("name"), bits=1).count() == 100_000
    assert member_filter(rows, "name", keys.limit(0)).count() == 0
    wanted, others = split_members(rows, "name", keys)
    assert wanted.count() + others.count() == 100_000 and not ids & {r.id for r in others.collect()}


def test_member_filter_keeps_wide_rows_where_they_are(spark, tmp_path):
    from estate.plans.shapes import member_filter

    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).write.parquet(str(tmp_path / "t"))
    spark.range(0, 20_000, 100).write.parquet(str(tmp_path / "k"))
    rows, keys = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "k"))
    kept = member_filter(rows, "id", keys)
    # Only what passes the bitmap would be dealt out by the exact join behind it.
    assert 200 <= kept.count() < 800
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert kept.join(keys, "id").count() == 200
