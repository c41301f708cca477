"""Statement text, masking, cursors, quotas, schedules, tags, ids."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from estate.functions import cursors as K
from estate.functions import masking, quota, units
from estate.functions import text as T
from estate.operators import bi, ingest, metrics
from estate.operators import querylog as Q


def one(frame, value, make, ddl="v string"):
    return frame([(value,)], ddl).select(make("v")).first()[0]


@pytest.mark.parametrize("sql,kind", [
    ("SELECT 1", "read"), ("", "read"), (None, None), ("-- x\n", "read"), ("/* a\nb */ Show tables", "read"),
    ("with x as (select 1) select 1", "read"), ("WITH x AS (DELETE FROM t) SELECT 1", "write"),
    ("FROM t", "read"), ("from t -- update", "read"), ("select;", "read"), ("COPY t TO 'f'", "write"),
    ("insert into t values (1)", "write"), ("with updated_rows as (select 1) table x", "read"),
])
def test_classify(frame, sql, kind):
    got = one(frame, sql, T.classify_sql)
    assert got == (kind or "write")


def test_fold_and_preview(frame):
    assert one(frame, "a \n\t b  c", T.fold_sql) == "a b c"
    assert one(frame, "x" * 200, lambda c: F.length(T.fold_sql(c))) == 180
    assert one(frame, " a\nb ", T.preview) == "a b"
    assert one(frame, "y" * 121, T.preview) == "y" * 119 + "…"
    assert one(frame, "y" * 120, T.preview) == "y" * 120


@pytest.mark.parametrize("text,masked", [
    ("postgresql://u:pw@h/db", "postgresql://u:***@h/db"),
    ("postgresql://h:5432/db", "postgresql://h:5432/db"),
    ("Authorization: Bearer abc | next", "Authorization: ***| next"),
    ("bearer  abc.def, x", "bearer ***, x"),
    ("token = \"0123456789\"", "token = ***"),
    ("x-token: Bearer abc", "x-token: *** ***"),
    ("x-api-key=abc&page=2", "x-api-key=***&page=2"),
    ("ALTER USER u\nPASSWORD 'a b'", "ALTER USER u PASSWORD ***"),
    ("PGPASSWORD='x y' psql", "PGPASSWORD=*** psql"),
    ("Password set: yes", "Password set: yes"),
    ("password='it''s' x", "password=*** x"), ("it''s fine", "it''s fine"), ("a\u0001b pwd=x", "a\u0001b pwd=***"),
    ("nothing here", "nothing here"),
])
def test_masking(frame, text, masked):
    got = one(frame, text, masking.mask_secrets)
    if text.startswith("x-token"):
        assert "abc" not in got
    else:
        assert got == masked


@pytest.mark.parametrize("text", [
    "token='" + "x " * 200000, "password = '" + "a''b " * 3000 + "' end", "secret=\"" + "y " * 200000 + "\" end",
    "authorization: '" + "z " * 200000, "basic " + "w" * 400000, "a." * 100000 + "token=x", "pwd " * 50000 + "pwd=1",
])
def test_masking_takes_whole_long_texts(frame, text):
    got = one(frame, text, masking.mask_secrets)
    assert "***" in got
    assert got.endswith(" end") or not text.endswith(" end")


@pytest.mark.parametrize("text,masked", [
    ("DB_SECRET_KEY: abc; x", "DB_SECRET_KEY: ***; x"), ('{"api_key": "a b", "n": 1}', '{"api_key": ***, "n": 1}'),
    ("proxy-authorization=Basic Zm9v, next", "proxy-authorization=***, next"), ("deauthorization: yes", "deauthorization: yes"),
    ("a=1&access-key=x&b=2", "a=1&access-key=***&b=2"), ("http://a:b@c http://d:e@f", "http://a:***@c http://d:***@f"),
    ("http://h/a:b@c", "http://h/a:b@c"), ("the secret is out", "the secret is out"), ("password = 'a' 'b'", "password = *** 'b'"),
    ("password '' x", "password *** x"), ("my_password2=x", "my_password2=x"), ("Basic = 1", "Basic = 1"),
    ("é.token=x", "é.token=***"), ("token=bearer abc", "token=*** ***"), (None, None), ("", ""),
])
def test_the_grammar_form_by_form(frame, text, masked):
    assert one(frame, text, masking.mask_secrets) == masked


def test_masking_time_follows_the_length(frame):
    import time

    def seconds(text):
        began = time.monotonic()
        assert one(frame, text, lambda c: F.length(masking.mask_secrets(c))) > 0
        return time.monotonic() - began

    for unit in ("token", "token.", "://u", "password '", "secret:", "bearer "):
        one(frame, unit, masking.mask_secrets)
        assert seconds(unit * (2_000_000 // len(unit))) < 8, unit


def test_classify_takes_long_texts(frame):
    assert one(frame, "\n " * 100000 + "select 1" + " \n" * 100000, T.classify_sql) == "read"
    assert one(frame, "/* " + "x\n" * 200000 + "*/ drop table t", T.classify_sql) == "write"


@pytest.mark.parametrize("value,day", [
    ("2024-06-01", date(2024, 6, 1)), ("20240601", date(2024, 6, 1)), (" 2024-06-01T00:00:00.123Z", date(2024, 6, 1)),
    ("2024-06-01 10:00:00+02:00", date(2024, 6, 1)), ("2024-06-01t10", date(2024, 6, 1)),
    ("2024-W23-6", date(2024, 6, 8)), ("2020-W53", date(2020, 12, 28)), ("2021-W53", None),
    ("2024-13-01", None), ("2024-02-30", None), ("12345", None), ("", None), ("lsn-1", None), ("1717200000", None),
    ("2024-06-01T25:00", None), ("2024-06", None),
])
def test_cursor_date(frame, value, day):
    assert one(frame, value, K.cursor_date) == day


@pytest.mark.parametrize("old,new", [
    ("2020-01-02", "2024-06-01"), ("20200102", "20240601"), ("2020-01-02T03:04:05.120Z", "2024-06-01T03:04:05.120Z"),
    ("2020-01-02 03:04:05+0200", "2024-06-01 03:04:05+0200"), ("20200102t03", "20240601t03"),
])
def test_rewrite_date_keeps_the_format(frame, old, new):
    assert one(frame, old, lambda c: K.rewrite_date(c, F.lit(date(2024, 6, 1)))) == new


def test_rewrite_xid(frame):
    df = frame([("5",), ("x",), ("-3",), ("1000",)], "v string")
    assert [r[0] for r in df.select(K.rewrite_xid("v", factor=0.5)).collect()] == [2, None, -2, 500]
    assert [r[0] for r in df.select(K.rewrite_xid("v", value=9)).collect()] == [9] * 4


@pytest.mark.parametrize("text,want", [
    ("50 gb", ("50 GB", 51200, True)), ("1024MB", ("1024 MB", 1024, True)), ("unlimited", ("UNLIMITED", None, True)),
    ("0 MB", (None, None, False)), ("5 KB", (None, None, False)), ("", (None, None, False)),
    ("007 TB", ("7 TB", 7 * 1048576, True)), ("1.5 GB", (None, None, False)),
])
def test_quota(frame, text, want):
    got = one(frame, text, quota.parse_quota)
    assert (got.text, got.mb, got.valid) == want


STATE = "connection_id bigint, namespace string, stream string, state string"


def plan(frame, state, **kw):
    df = frame([(1, "n", "s", state)], STATE)
    return {r.key: (r.old, r.new, r.action) for r in ingest.plan_rewrites(df, **kw).collect()}


def test_cursor_actions(frame):
    state = '{"cursor": "2024-05-05T00:00:00Z", "id": 20240505, "cursor_record_count": 3}'
    got = plan(frame, state, to=date(2024, 1, 1))
    assert got["cursor"] == ("2024-05-05T00:00:00Z", "2024-01-01T00:00:00Z", "rewrite")
    assert got["id"][2] == "skip:opaque"
    assert got["cursor_record_count"] == ("3", "0", "reset:count")
    assert plan(frame, state)["cursor"][2] == "skip:date"
    later = plan(frame, state, to=date(2024, 9, 1), only_rewind=True)
    assert later["cursor"][2] == "skip:advance" and later["cursor_record_count"][2] == "skip:opaque"
    zero = plan(frame, '{"c": "2024-05-05", "cursor_record_count": 0}', to=date(2024, 1, 1))
    assert zero["cursor_record_count"][2] == "skip:opaque"


def test_xmin_actions(frame):
    state = '{"state_type": "xmin", "xmin_xid_value": 1001, "xmin_raw_value": 1001, "version": 2}'
    assert plan(frame, state) == {"xmin": ("1001", "1001", "skip:xmin")}
    assert plan(frame, state, xid_factor=0.1) == {"xmin": ("1001", "100", "rewrite:xmin")}
    assert plan(frame, state, xid_value=2000, only_rewind=True)["xmin"] == ("1001", "1001", "skip:advance")
    broken = state.replace('"xmin_xid_value": 1001', '"xmin_xid_value": "n/a"')
    assert plan(frame, broken, xid_factor=0.1)["xmin"][2] == "skip:xmin"
    assert plan(frame, broken, xid_value=7)["xmin"][1:] == ("7", "rewrite:xmin")


def test_non_stream_state_gives_nothing(frame):
    assert plan(frame, "[1]", to=date(2024, 1, 1)) == {}
    assert plan(frame, "not json", to=date(2024, 1, 1)) == {}
    assert plan(frame, None, to=date(2024, 1, 1)) == {}


def test_rewritten_state_keeps_other_fields(frame):
    df = frame([(1, "n", "s", '{"cursor": "20240505", "id": 7, "cursor_record_count": 3}'),
                (1, "n", "x", '{"state_type": "xmin", "xmin_xid_value": 10, "num_wraparound": 1}')], STATE)
    got = {r.stream: r.new_state for r in ingest.rewritten_states(df, to=date(2024, 1, 1), xid_factor=0.5).collect()}
    import json
    assert json.loads(got["s"]) == {"cursor": "20240101", "id": 7, "cursor_record_count": 0}
    assert json.loads(got["x"]) == {"state_type": "xmin", "xmin_xid_value": 5, "num_wraparound": 1}


TAG = "array<struct<tagId:string,id:string,name:string>>"


def test_merge_tags(frame):
    df = frame([([("1", None, "a"), (None, "2", "b")], [(None, "1", "c"), (None, None, "lost"), ("3", None, "d")]),
                (None, [("9", None, "z")])], f"a {TAG}, b {TAG}")
    got = [[(t.tagId, t.name) for t in r[0]] for r in df.select(ingest.merge_tags("a", "b")).collect()]
    assert got == [[("1", "c"), ("2", "b"), ("3", "d")], [("9", "z")]]


@pytest.mark.parametrize("cron,expression,zone,valid", [
    ("0 0 12 * * ? UTC", "0 0 12 * * ?", "UTC", True), ("0 0 12 * * ? Mars/Base", "0 0 12 * * ? Mars/Base", None, False),
    ("*/5 * * * *", "*/5 * * * *", None, True), ("61 * * * *", "61 * * * *", None, False),
    ("0 0 1-5 ? * MON-FRI 2030 Europe/Paris", "0 0 1-5 ? * MON-FRI 2030", "Europe/Paris", True),
    ("* *", "* *", None, False),
])
def test_schedules(frame, cron, expression, zone, valid):
    df = frame([(1, "cron", cron, None, None)], "connection_id int, schedule_type string, cron_expression string, "
               "cron_time_zone string, basic_timing string")
    row = ingest.schedule_report(df).first()
    assert (row.expression, row.time_zone, row.valid) == (expression, zone, valid)
    assert row.display == "cron:" + expression + (f" {zone}" if zone else "")


def test_id_list(frame):
    assert one(frame, '[1, {"id": 2}, {"id": "3"}, "4", 5.5, null, {"x": 1}]', bi.id_list) == [1, 2]
    assert one(frame, "no list", bi.id_list) == []


def test_group_changes(frame, rows):
    users = frame([(1, [1], [1, 2]), (2, [1], [3]), (3, [], [])], "user_id int, role_ids array<bigint>, group_ids array<bigint>")
    assert rows(bi.group_change_plan(users, add=[1], remove=[2]), "user_id", "groups_after") == [
        (1, [1]), (2, [1, 3]), (3, [1])]
    assert rows(bi.group_change_plan(users, set_=[]), "user_id", "groups_after") == [(1, []), (2, [])]
    with pytest.raises(ValueError):
        bi.group_change_plan(users, add=[1], set_=[2])


@pytest.mark.parametrize("mode,ids", [("exact", [2]), ("subset", [1, 2]), ("any", [1, 2, 3])])
def test_role_filters(frame, rows, mode, ids):
    users = frame([(1, [5]), (2, [5, 7]), (3, [7, 9]), (4, [])], "user_id int, role_ids array<bigint>")
    assert [r[0] for r in rows(bi.filter_users(users, [5, 7], mode), "user_id")] == ids


LOG = "query_id string, user_name string, target string, status string, start_time timestamp_ntz, duration_s bigint, query_text string"


def test_triage_edges(frame, rows):
    now = datetime(2024, 1, 2, 12)
    at = lambda h, s=0: datetime(2024, 1, 2, 12 - h, 0, s) if h <= 12 else datetime(2024, 1, 1)
    log = frame([
        ("slow", "u", "w", "success", at(1), 61, "q"), ("fast", "u", "w", "success", at(1), 59, "q"),
        ("old", "u", "w", "success", at(7), 500, "q"), ("live", "u", "w", "RUNNING", at(20), None, "q"),
        ("failed", "u", "w", "Cancelled", at(2), 1, "q"), ("oldfail", "u", "w", "failed", at(8), 1, "q"),
    ], LOG)
    got = {r.query_id: r["rank"] for r in Q.triage(log, now).collect()}
    assert got == {"live": 1, "slow": 2, "failed": 3}


def test_column_drift(frame):
    df = frame([("q1", "bob")], "query string, Usename string")
    assert df.select(Q.pick(df, ["query_id", "query"], required=True), Q.pick(df, ["usename"])).first()[:] == ("q1", "bob")
    assert df.select(Q.pick(df, ["nothing"], "d")).first()[0] == "d"
    with pytest.raises(ValueError):
        Q.pick(df, ["nothing"], required=True)


def test_metric_summary_is_mean_of_means(frame):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    points = frame([("s", "m", t(1), 1.0), ("s", "m", t(2), 3.0), ("s", "m", t(7), 10.0)],
                   "scope string, metric string, ts timestamp_ntz, value double")
    want = frame([("s", "m"), ("s", "idle")], "scope string, metric string")
    got = {r.metric: r for r in metrics.metric_summary(points, datetime(2024, 1, 1, 1), expected=want).collect()}
    assert (got["m"].latest, got["m"].average, got["m"].min, got["m"].max) == (10.0, 6.0, 1.0, 10.0)
    assert got["idle"].latest is None


@pytest.mark.parametrize("value,unit,metric,text", [
    (12.345, "Percent", "CPU", "12.35%"), (1024.0**3, "Bytes", "x", "1.00 GB"), (2048.0, "Megabytes", "x", "2.00 GB"),
    (3.0, "Seconds", "x", "3.00s"), (4.0, "Microseconds", "x", "4.00 Microseconds"), (2.5, "None", "QueryCount", "2"),
    (None, "Percent", "x", "—"),
])
def test_metric_text(frame, value, unit, metric, text):
    df = frame([(value, unit, metric)], "v double, u string, m string")
    assert df.select(units.format_metric(F.col("v"), F.col("u"), F.col("m"))).first()[0] == text
