"""Readers, sinks, streams, and the physical plans of the headline queries."""

import json
import os
import subprocess
import sys
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from estate.operators import describe as D
from estate.plans.shapes import top_k
from estate.session import SCRATCH_KEY, discard, scratch_dir, scratch_path
from estate.sources import audit, pages, sinks, snapshot
from estate.streaming import monitors

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_follows_the_session(spark, tmp_path):
    named = spark.conf.get(SCRATCH_KEY, None)
    spark.conf.set(SCRATCH_KEY, f"file://{tmp_path}/")
    try:
        path = scratch_path(spark, "x")
        assert path.startswith(f"file://{tmp_path}/x-")
        spark.range(3).write.parquet(path)
        discard(spark, path)
        assert not list(tmp_path.iterdir())
    finally:
        spark.conf.unset(SCRATCH_KEY)
        if named:
            spark.conf.set(SCRATCH_KEY, named)
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        assert scratch_dir(spark) == (named or configured).rstrip("/")


PLAIN = """
import __spark_entry__ as entry
from estate.testing import local_session
spark = local_session()
assert not spark.conf.get("spark.checkpoint.dir", None)
queries = entry.queries()
for name in ("e1_ancestors", "o4_orphan_summary", "a8_write_audit", "s1_metric_stream"):
    assert queries[name](spark, "%s").count() > 0, name
from estate import session
made = session.scratch_dir(spark)
session.clear_scratch(spark)
import os
assert not os.listdir(made.removeprefix("file://")), os.listdir(made)
print("plain session works")
"""


def test_scratch_on_a_plain_spark(tmp_path):
    """A fresh process whose Spark presets nothing."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", PLAIN % SF], env=env, cwd=ROOT, capture_output=True, text=True)
    assert "plain session works" in run.stdout, run.stderr[-2000:]


def test_rename_log_skips_what_it_cannot_use(spark, tmp_path):
    entry_ok = {"database": "w", "schema": "s", "old_name": "a", "new_name": "a_deprecated", "kind": "table"}
    logs = {
        "good": {"generated_at": "2024-01-01T00:00:00+00:00", "dry_run": False, "renames": [entry_ok, {"schema": "x"}]},
        "dry": {"generated_at": "2024-01-02T00:00:00", "dry_run": True, "renames": [entry_ok]},
        "undated": {"generated_at": "soon", "renames": [entry_ok]},
        "list": [1, 2],
    }
    for name, payload in logs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=2))
    (tmp_path / "broken.json").write_text('{"generated_at": "2024')
    got = audit.read_rename_log(spark, str(tmp_path), one_per_file=True).collect()
    assert [(r.target, r.new_name, r.generated_at) for r in got] == [("w", "a_deprecated", datetime(2024, 1, 1))]


def test_pages_one_per_file(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"result": {"result": [{"id": 1}]}}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"data": []}))
    (tmp_path / "3.json").write_text("oops")
    got = pages.read_pages(spark, str(tmp_path), one_per_file=True).select(pages.field("item", "tagId", "id"))
    assert [r[0] for r in got.collect()] == ["1"]


def test_missing_pages_prefers_total_pages(frame, rows):
    df = frame([("a", 0, 10, 95, None, 3), ("b", 0, 10, 25, 99, None), ("b", 2, 10, 25, 99, None), ("c", 0, 10, None, 10, None)],
               "resource string, page bigint, page_size int, count bigint, total bigint, total_pages bigint")
    assert rows(pages.missing_pages(df)) == [("a", 1), ("a", 2), ("b", 1)]


def test_missing_pages_over_many_chunks(frame):
    df = frame([("a", 9999, 1, 10000, None, None)],
               "resource string, page bigint, page_size int, count bigint, total bigint, total_pages bigint")
    assert pages.missing_pages(df).agg(F.count("*"), F.min("page"), F.max("page")).first()[:] == (9999, 0, 9998)


def test_audit_appends(spark, frame, tmp_path):
    df = frame([("w",)], "target string")
    path = str(tmp_path / "log")
    audit.write_audit(df, path, datetime(2024, 1, 1, 5), True)
    audit.write_audit(df, path, datetime(2024, 1, 2, 5), False)
    back = spark.read.json(path)
    assert sorted((str(r.run_date), r.dry_run) for r in back.collect()) == [("2024-01-01", True), ("2024-01-02", False)]


def test_optional_source(spark, frame, tmp_path):
    path = str(tmp_path / "there")
    frame([], "a int").write.parquet(path)
    df, available = snapshot.read_optional(spark, path, "a int")
    assert available and df.count() == 0
    df, available = snapshot.read_optional(spark, path + "-not", "a int")
    assert not available and df.columns == ["a"]


def test_snapshot_kind_must_exist(spark):
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, "nothing", "/x")
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, "relations")


def test_flatten(frame):
    df = frame([(1, None, [1, 2], {"k": "v"})], "b int, a string, c array<int>, d map<string,string>")
    out = sinks.flatten_for_export(df)
    assert out.columns == ["a", "b", "c", "d"]
    assert out.first()[:] == ("N/A", "1", "[1,2]", '{"k":"v"}')
    with pytest.raises(ValueError):
        sinks.export(df, "/x", "xml")


def test_tree_rollup_counts_leaves_once(frame):
    rel = frame([(1, "p", 100, 10, 8, 1), (2, "r", 40, 20, 16, 3), (3, "r", -1, 5, 4, 1), (4, "r", 7, 9, 9, 0)],
                "relation_id bigint, relkind string, row_estimate bigint, total_size bigint, table_size bigint, index_size bigint")
    tree = frame([(2, 1), (3, 1)], "child_id bigint, parent_id bigint")
    got = {r.relation_id: (r.descendants, r.row_estimate, r.total_size, r.toast_size) for r in D.tree_rollup(rel, tree).collect()}
    assert got == {1: (2, 40, 35, 2), 2: (0, 40, 20, 1), 3: (0, None, 5, 0), 4: (0, 7, 9, 0)}


def test_column_report_takes_one_foreign_key(frame):
    cons = D.constraint_report(frame(
        [(1, "fk_b", "f", 1, "x", "t2", "b", "c", None), (1, "fk_a", "f", 1, "x", "t1", "a", None, "r"),
         (1, "pk", "p", 2, "x", None, None, None, None), (1, "pk", "p", 1, "y", None, None, None, None),
         (1, "nn", "n", 1, "x", None, None, None, None)],
        "relation_id bigint, con_name string, contype string, pos int, column_name string, ref_table string, "
        "ref_column string, del_code string, upd_code string"))
    kinds = {r.con_name: (r.columns, r.on_delete, r.on_update, r.position) for r in cons.collect()}
    assert kinds["pk"] == (["y", "x"], None, None, 0) and kinds["fk_b"] == (["x"], "CASCADE", "NO ACTION", 2)
    assert "nn" not in kinds
    cols = frame([(1, 1, "x", "int", True, "d", "nextval", None), (1, 2, "z", "int", False, "", "0", None)],
                 "relation_id bigint, ordinal int, column_name string, data_type string, not_null boolean, "
                 "identity_code string, default_expr string, comment string")
    got = {r.column_name: r for r in D.column_report(cols, cons).collect()}
    assert (got["x"].is_pk, got["x"].fk_table, got["x"].default_short) == (True, "t1", "identity (default)")
    assert (got["z"].is_pk, got["z"].fk_table, got["z"].nullable, got["z"].default_expr) == (False, None, True, "0")


def test_lineage_over_several_views(frame, rows):
    edges = frame([(3, 2), (2, 1), (3, 1)], "view_id bigint, source_id bigint")
    assert rows(D.view_lineage(edges)) == [(2, 1, 1), (3, 1, 1), (3, 2, 1)]


def test_policies_without_roles_are_not_joined(spark, frame, rows):
    policies = frame([(1, "p", "r", [1, 2, 1]), (1, "p", "r", None), (2, "q", "*", []), (3, "x", "a", [9]), (3, "x", "a", [None])],
                     "relation_id bigint, policy_name string, command_code string, role_ids array<bigint>")
    roles = frame([(1, "b"), (2, "a"), (None, "never")], "role_id bigint, role string")
    report = D.policy_report(policies, roles)
    got = {(r.relation_id, r.policy_name, r.command): r.roles for r in report.collect()}
    assert got == {(1, "p", "SELECT"): ["a", "b"], (2, "q", "ALL"): ["public"], (3, "x", "INSERT"): ["public"]}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    # Rows without a role come beside the join.
    assert plan.index("Union") < plan.index("Join ")


def plan_text(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.split("_")[0] in (
    "c1", "c5", "c6", "c7", "b6", "b9", "q1", "q4", "q8", "e3", "e9", "e13", "g5", "g7", "o3", "o6", "d2", "d11",
    "i4", "i12", "m1", "m3", "u5", "k4")])
def test_plans_hold_no_product_and_no_python(spark, name):
    text = plan_text(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", ["c1_top_relations", "c5_schema_highlights", "q1_triage", "b9_busy_connections", "c7_cap_hidden"])
def test_top_k_is_pruned_before_the_shuffle(spark, name):
    text = plan_text(entry.queries()[name](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(entry.queries()["c6_page_after"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,1000)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_a_statement_is_classified_without_a_job(spark):
    from estate.functions.text import classify_sql

    plan = spark.sql("VALUES (1)").select(classify_sql(F.lit("SELECT 1")))._jdf.queryExecution().executedPlan()
    assert plan.nodeName() == "LocalTableScan"


NO_LLM = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in (%r, "public_tokenizers"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert "c1_top_relations" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
print("entry stands alone")
"""


@pytest.mark.parametrize("gone", ["estate.llm.queries", "corpus_pipeline", "estate.llm"])
def test_the_entry_works_without_what_is_optional(gone):
    run = subprocess.run([sys.executable, "-c", NO_LLM % gone], cwd=ROOT, capture_output=True, text=True)
    assert "entry stands alone" in run.stdout, run.stderr[-2000:]


def test_scratch_made_on_the_way_is_removed(spark):
    from estate import session

    with session.transient(spark) as keep:
        big = session.materialize(spark.range(10), "on-the-way")
        small = keep(big.where("id < 3"), "kept")
    assert small.count() == 3 and not any("on-the-way" in p for p in session._MADE)
    with pytest.raises(Exception, match="(?i)not_exist|not exist|not found"):
        big.count()
    session.release(small)
    with pytest.raises(Exception, match="(?i)not_exist|not exist|not found"):
        small.count()


def test_only_reads_run_unless_asked(spark):
    tables = {"one_row": spark.range(1)}
    assert snapshot.run_sql(spark, "SELECT id + 1 AS n FROM one_row", tables).first().n == 1
    assert not spark.catalog.tableExists("one_row")
    for sql in ("CREATE TEMP VIEW v AS SELECT 1", "-- note\n DROP TABLE t", "WITH q AS (SELECT 1) INSERT INTO t SELECT * FROM q"):
        with pytest.raises(ValueError, match="may write"):
            snapshot.run_sql(spark, sql, tables)
    snapshot.run_sql(spark, "CREATE TEMP VIEW made_view AS SELECT id FROM one_row", tables, write=True)
    spark.catalog.dropTempView("made_view")
    spark.range(1).createTempView("one_row")
    try:
        with pytest.raises(ValueError, match="taken"):
            snapshot.run_sql(spark, "SELECT * FROM one_row", tables)
        assert spark.catalog.tableExists("one_row")
    finally:
        spark.catalog.dropTempView("one_row")


def test_a_target_that_fails_when_run_is_told(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("gone away")).cast("bigint").alias("id"))
    rows, failed = snapshot.union_targets(spark, {"a": spark.range(2), "b": bad, "c": lambda: spark.range(1)})
    assert sorted(r.target for r in rows.collect()) == ["a", "a", "c"]
    (row,) = failed.collect()
    assert row.target == "b" and "gone away" in row.message and len(row.message) <= snapshot.ERROR_WIDTH


def test_an_optional_source_lets_other_failures_out(spark, tmp_path):
    assert not snapshot.read_optional(spark, str(tmp_path / "none"), "id bigint")[1]
    (tmp_path / "torn.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        snapshot.read_optional(spark, str(tmp_path / "torn.parquet"), "id bigint")


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "start_time timestamp_ntz, status string"
    jobs = lambda hours: spark.createDataFrame(
        [(datetime(2024, 1, 1 + h // 24, h % 24, 5), "failed" if h % 2 else "done") for h in hours], schema)
    jobs(range(0, 30)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: monitors.job_health_stream(
        monitors.read_stream(spark, str(tmp_path / "in"), jobs([0]).schema), span="2 hours")
    first = monitors.run_available(stream(), str(tmp_path / "run"))
    before = {tuple(r) for r in first.collect()}
    jobs(range(30, 60)).write.mode("append").parquet(str(tmp_path / "in"))
    after = [tuple(r) for r in monitors.run_available(stream(), str(tmp_path / "run")).collect()]
    assert before and before < set(after) and len(after) == len(set(after))
    inner = [r for r in after if datetime(2024, 1, 1, 0) <= r[0] < datetime(2024, 1, 3, 8)]
    assert len(inner) == 56 and all(r[1:3] == (2, 1) for r in inner)


def test_alerts_without_a_clock_use_the_time_of_the_batch(spark, tmp_path):
    schema = "query_id string, user_name string, status string, start_time timestamp_ntz, duration_s bigint"
    log = spark.range(2).select(
        F.col("id").cast("string").alias("query_id"), F.lit("u").alias("user_name"), F.lit("running").alias("status"),
        (F.current_timestamp() - F.expr("INTERVAL '90' SECOND") * (1 - F.col("id"))).cast("timestamp_ntz").alias("start_time"),
        F.lit(None).cast("bigint").alias("duration_s"))
    log.write.parquet(str(tmp_path / "in"))
    stream = monitors.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    got = monitors.run_available(monitors.alert_stream(stream, min_s=60), str(tmp_path / "run")).collect()
    assert [r.query_id for r in got] == ["0"]


LOG = "query_id string, user_name string, status string, start_time timestamp_ntz, duration_s bigint"


def test_a_live_statement_is_reported_once_it_has_outlasted_the_limit(spark, tmp_path):
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    at = lambda s: now + timedelta(seconds=s)

    def hand_in(*rows):
        spark.createDataFrame([(q, "u", *r) for q, *r in rows], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = monitors.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LOG).schema)
        got = monitors.run_available(monitors.alert_stream(stream, min_s=60), str(tmp_path / "run"))
        return sorted((r.query_id, r.elapsed_s) for r in got.collect())

    # Live and young: nothing yet. "quick" will end in time, "slow" after, "lost" never.
    assert hand_in(("quick", "running", at(0), None), ("slow", "running", at(0), None), ("lost", "queued", at(5), None)) == []
    assert hand_in(("quick", "success", at(0), 30), ("slow", "success", at(0), 200)) == [("slow", 200)]
    # The clock of the log moves on; neither row is handed in again.
    after = hand_in(("later", "success", at(5 * 3600), 1), ("later2", "running", at(5 * 3600), None))
    after = hand_in(("more", "success", at(6 * 3600), 1), ("more2", "running", at(6 * 3600), None))
    assert after == [("lost", 60), ("slow", 200)]


def test_what_outlasts_equals_the_batch_filter(spark, tmp_path):
    start = datetime(2024, 1, 1)
    live = [(f"q{i}", "u", "running", start + timedelta(seconds=7 * i), None) for i in range(200)]
    ends = [(f"q{i}", "u", "done", start + timedelta(seconds=7 * i), i % 130) for i in range(0, 200, 2)]
    clock = [("z", "u", s, start + timedelta(hours=9), d) for s, d in (("running", None), ("done", 1))]
    rows = spark.createDataFrame(live + ends + clock, LOG)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = monitors.read_stream(spark, str(tmp_path / "in"), rows.schema)
    got = monitors.run_available(monitors.outlasting_stream(stream, 60, "1 hour"), str(tmp_path / "run"))
    quick = {f"q{i}" for i in range(0, 200, 2) if i % 130 < 60}
    assert sorted(r.query_id for r in got.collect()) == sorted({q for q, *_ in live} - quick)


def test_sections_run_side_by_side_and_one_that_hangs_costs_one_row(spark):
    from estate.operators.health import health

    def count():
        return spark.range(3).groupBy(F.lit("t").alias("target")).agg(F.count("*").alias("rows"))

    def hangs():
        time.sleep(600)

    def endless():
        return spark.range(10**13).groupBy(F.lit("t").alias("target")).agg(F.max(F.xxhash64("id")).alias("n"))

    began = time.monotonic()
    out = health(spark, [("a", count), ("stuck", hangs), ("busy", endless), ("b", count)], width=2, limit_s=8)
    got = {(r.system, r.figure): (r.available, r.value, r.error) for r in out.collect()}
    assert time.monotonic() - began < 60
    assert got["a", "rows"] == got["b", "rows"] == (True, 3.0, None)
    assert got["stuck", "reachable"] == got["busy", "reachable"] == (False, 0.0, "TimeoutError")
    assert len(got) == 6
    # What was given up does not go on: nothing of it holds the executors.
    assert spark.range(10).count() == 10


def test_sections_see_the_callers_properties_and_keep_their_order(spark):
    from estate.plans.concurrent import side_by_side

    context = spark.sparkContext
    context.setLocalProperty("estate.test", "seen")
    pools = set()

    def job(n):
        def run():
            pools.add(context.getLocalProperty("spark.scheduler.pool"))
            if n == 3:
                raise KeyError("three")
            return n, context.getLocalProperty("estate.test")
        return run

    out = side_by_side(spark, {n: job(n) for n in range(6)}, width=3)
    context.setLocalProperty("estate.test", None)
    assert list(out) == list(range(6)) and isinstance(out.pop(3), KeyError)
    assert list(out.values()) == [(n, "seen") for n in (0, 1, 2, 4, 5)]
    assert len(pools) == 6 and context.getLocalProperty("spark.scheduler.pool") is None
    assert side_by_side(spark, {}) == {}


def test_targets_are_read_side_by_side(spark):
    began = time.monotonic()
    reports = {f"t{i}": (lambda i=i: time.sleep(1.5) or spark.range(i).withColumnRenamed("id", "n")) for i in range(6)}
    reports["gone"] = lambda: spark.table("no_such_table")
    reports["stuck"] = lambda: time.sleep(600)
    rows, failed = snapshot.union_targets(spark, reports, limit_s=20)
    assert rows.count() == 15 and time.monotonic() - began < 40
    assert {r.target: r.error for r in failed.collect()} == {"gone": "AnalysisException", "stuck": "TimeoutError"}


@pytest.mark.parametrize("n", [3, 1500])
def test_a_hot_group_is_ranked_like_any_other(spark, n):
    df = spark.range(6000).select((F.col("id") % 10 == 0).alias("small"), "id")
    got = top_k(df, ["small"], [F.col("id").desc()], n)
    assert got.where("not small").count() == n
    assert got.where("not small and rank = 1").first().id == 5999
    assert got.where("small").count() == min(n, 600)
