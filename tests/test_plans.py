"""Grants, principals, orphans and their edges on hand-sized frames."""

from collections import Counter
from datetime import datetime

import pytest

from estate.operators import grants as G
from estate.operators import orphans as O
from estate.operators import principals as N
from estate.report_order import in_report_order

REL = "relation_id bigint, target string, schema_name string, relation_name string, relkind string"
INH = "child_id bigint, parent_id bigint"
LIVE = "target string, schema_name string, relation_name string"


def test_privileges_expand_in_order(frame):
    df = frame([(1, "read"), (2, "Delete, CREATE"), (3, "drop,usage"), (4, " , ")], "id int, tokens string")
    got = {r.id: (r.privileges, r.unknown, r.status) for r in G.expand_privileges(df).collect()}
    assert got[1] == (["usage", "select", "default-select"], [], "ok")
    assert got[2] == (["usage", "create", "delete"], [], "ok")
    assert got[3] == (["usage"], ["drop"], "unknown_privilege")
    assert got[4] == ([], [], "no_privilege")


def test_requests_merge_per_grantee(frame):
    df = frame([("a", "read"), ("a", "create"), ("b", "nope")], "grantee string, tokens string")
    got = {r.grantee: (r.requests, r.bad_requests, r.privileges) for r in G.merge_requests(df).collect()}
    assert got == {"a": (2, 0, ["usage", "create", "select", "default-select"]), "b": (1, 1, [])}


REQ = ("request_id int, engine string, schemas array<string>, grantee string, kind string, "
       "privileges array<string>")
HELD = "schema_name string, grantee string, privilege string"
OWN = "schema_name string, owner string"


def grant(frame, request, held=(), owners=(("s", "boss"),), **kw):
    plan = G.schema_grant_plan(frame([request], REQ), frame(list(held), HELD), frame(list(owners), OWN), **kw)
    return {(r.schema_name, r.privilege): (r.action, r.statement) for r in plan.collect()}


def test_held_is_skipped_on_grant_but_not_on_revoke(frame):
    request = (1, "postgresql", ["s"], "bob", "user", ["usage", "select"])
    held = [("s", "bob", "usage"), ("s", "bob", "select")]
    got = grant(frame, request, held)
    assert got["s", "usage"] == ("already_held", None)
    assert got["s", "select"] == ("grant", 'GRANT SELECT ON ALL TABLES IN SCHEMA "s" TO "bob";')
    undo = grant(frame, request, held, revoke=True, cascade=True)
    assert undo["s", "usage"] == ("revoke", 'REVOKE USAGE ON SCHEMA "s" FROM "bob" CASCADE;')


def test_future_privileges_need_a_grantor(frame):
    request = (1, "redshift", ["s", "t"], "crew", "group", ["default-all", "sequence-usage"])
    got = grant(frame, request)
    assert got["s", "default-all"][1] == (
        'ALTER DEFAULT PRIVILEGES FOR USER "boss" IN SCHEMA "s" GRANT ALL ON TABLES TO GROUP "crew";')
    assert got["t", "default-all"] == ("error:no_grantor", None)
    assert got["s", "sequence-usage"] == ("skip:unsupported", None)
    assert grant(frame, request, default_for="etl")["t", "default-all"][0] == "grant"


def test_public_and_missing_grantees(frame):
    public = grant(frame, (1, "redshift", ["s"], "public", None, ["default-select"]))
    assert public["s", "default-select"][1].endswith("TO PUBLIC;")
    assert grant(frame, (1, "redshift", ["s"], "ghost", None, ["usage"]))["s", "usage"][0] == "error:grantee_not_found"
    role = grant(frame, (1, "redshift", ["s"], "r", "role", ["default-select"]))
    assert role["s", "default-select"][0] == "skip:unsupported"


def test_held_needs_the_right_kind(frame, rows):
    acl = frame([("s", "x", "user", "USAGE"), ("s", "x", "group", "CREATE"), ("s", None, None, "USAGE")],
                "schema_name string, grantee string, grantee_kind string, privilege string")
    grantees = frame([("x", "user"), ("Public", "role"), ("y", None)], "name string, kind string")
    assert rows(G.held_schema_privileges(acl, grantees)) == [("s", "PUBLIC", "usage"), ("s", "x", "usage")]


def test_membership_plan(frame):
    principals = frame([("team", "group"), ("r", "role"), ("bob", "user")], "name string, kind string")
    held = frame([("team", "bob")], "role string, grantee string")
    requests = frame([(1, "redshift", ["team", "r", "bob", "gone"], ["bob", "r", "team", "new"])],
                     "request_id int, engine string, roles array<string>, grantees array<string>")
    plan = N.grant_plan(requests, principals, held, create_missing_users=True)
    got = {(r.role, r.grantee): r.action for r in plan.collect()}
    assert got["team", "bob"] == "already_held"
    assert got["team", "r"] == "invalid" and got["r", "team"] == "invalid" and got["bob", "r"] == "invalid"
    assert got["r", "new"] == "create_user_and_grant" and got["gone", "bob"] == "error"
    strict = N.grant_plan(requests, principals, held)
    assert {r.action for r in strict.where("grantee = 'new'").collect()} == {"error"}


def test_membership_pairs_are_not_moved_by_joins_on_names(spark, frame):
    schema = "request_id int, engine string, roles array<string>, grantees array<string>"
    requests = frame([(1, "postgresql", ["r", "r", None], ["bob", "new"]), (1, "postgresql", ["r"], ["bob"]),
                      (None, None, ["r"], []), (3, "redshift", None, ["bob"])], schema)
    principals = frame([("r", "role"), ("bob", "user")], "name string, kind string")
    held = frame([("r", "bob"), ("r", "bob"), (None, "bob")], "role string, grantee string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.grant_plan(requests, principals, held, create_missing_users=True)
        got = Counter((r.request_id, r.role, r.grantee, r.action) for r in plan.collect())
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(1, "r", "bob", "already_held"): 4, (1, "r", "new", "create_user_and_grant"): 1,
                   (1, None, "bob", "error"): 1, (1, None, "new", "error"): 1}
    by_name = [n for n, line in enumerate(lines) if "Join LeftOuter" in line and "name" in line]
    pairs = [n for n, line in enumerate(lines) if "Generate explode(_of" in line]
    # A plan is printed from its top: pairs are made above the joins on names.
    assert by_name and pairs and min(pairs) < min(by_name)


def test_applied_plan_has_nothing_left(frame):
    principals = frame([("r", "role"), ("bob", "user")], "name string, kind string")
    requests = frame([(1, "postgresql", ["r"], ["bob"])],
                     "request_id int, engine string, roles array<string>, grantees array<string>")
    first = N.grant_plan(requests, principals, frame([], "role string, grantee string"))
    again = N.grant_plan(requests, principals, first.select("role", "grantee"))
    assert [r.action for r in again.collect()] == ["already_held"]


def scan(frame, relations, inherits=(), live=()):
    rel, inh, alive = frame(list(relations), REL), frame(list(inherits), INH), frame(list(live), LIVE)
    return O.orphans(O.existing_relations(rel, inh, alive), alive)


def test_no_live_model_means_no_orphans(frame):
    assert scan(frame, [(1, "w", "s", "a", "r")]).count() == 0


def test_orphans_skip_live_suffixed_children_and_other_targets(frame, rows):
    relations = [(1, "w", "s", "live", "r"), (2, "w", "s", "dead", "v"), (3, "w", "s", "x_deprecated", "r"),
                 (4, "w", "s", "part", "r"), (5, "w", "s", "parent", "p"), (6, "z", "s", "dead", "r"),
                 (7, "w", "s", "kid", "r"), (8, "w", "s", "seq", "S"), (9, "w", "other", "q", "r")]
    found = scan(frame, relations, [(4, 5), (7, 1)], [("w", "s", "live")])
    assert rows(found, "relation_name") == [("dead",), ("kid",), ("parent",)]


def test_rename_then_revert_is_identity(frame, rows):
    relations = [(1, "w", "s", "a", "r"), (2, "w", "s", "b", "v"), (3, "w", "s", "b_deprecated", "r")]
    now = frame(relations, REL)
    found = frame([("w", "s", "a"), ("w", "s", "b"), ("w", "s", "gone")], LIVE)
    plan = O.rename_plan(found, now)
    assert rows(plan, "relation_name", "action") == [
        ("a", "rename"), ("b", "skip:collision"), ("gone", "skip:vanished")]
    after = frame([(1, "w", "s", "a_deprecated", "r"), *relations[1:]], REL)
    log = plan.where("action = 'rename'").selectExpr(
        "target", "schema_name", "relation_name AS old_name", "new_name", "false AS dry_run")
    undo = O.revert_plan(log, after).first()
    assert (undo.action, undo.statement) == ("revert", 'ALTER TABLE "s"."a_deprecated" RENAME TO "a";')


@pytest.mark.parametrize("day,reason", [(datetime(2024, 1, 1), "due"), (datetime(2024, 1, 2), "due"),
                                        (datetime(2024, 1, 2, 0, 0, 1), "grace"), (None, "unknown")])
def test_grace_period_edges(frame, day, reason):
    dep = frame([(1, "w", "s", "a_deprecated", "table")], "relation_id bigint, target string, schema_name string, "
                "relation_name string, kind string")
    renames = frame([("w", "s", "a_deprecated", day)] if day else [], LIVE + ", renamed_at timestamp_ntz")
    row = O.purge_plan(dep, renames, datetime(2024, 2, 1), 30).first()
    assert (row.reason, row["drop"]) == (reason, reason == "due")
    forced = O.purge_plan(dep, renames, datetime(2024, 2, 1), 30, include_unknown=True).first()
    assert forced["drop"] == (reason != "grace")


def test_one_blocked_drop_holds_back_its_target(frame):
    plan = frame([(1, "w", "s", "a", "table", True), (2, "w", "s", "b", "table", True), (3, "z", "s", "c", "view", True)],
                 "relation_id bigint, target string, schema_name string, relation_name string, kind string, drop boolean")
    relations = frame([(1, "w", "s", "a", "r"), (9, "w", "s", "v", "v")], REL)
    blocked = O.blocked_drops(plan, frame([(9, 1), (9, 1), (1, 1)], "view_id bigint, source_id bigint"), relations)
    assert [r.dependent for r in blocked.collect()] == ['view "s"."v"']
    got = {r.relation_id: r.decision for r in O.purge_decision(plan, blocked).collect()}
    assert got == {1: "blocked", 2: "held_back", 3: "drop"}


def test_principal_kinds(frame):
    principals = frame([("a", "user"), ("b", "user"), ("b", "group")], "name string, kind string")
    names = frame([("a",), ("a",), ("b",), ("c",), ("Public",)], "name string")
    got = {r.name: (r.kind, r.status) for r in N.resolve_kinds(names, principals).collect()}
    assert got == {"a": ("user", "ok"), "b": (None, "ambiguous"), "c": (None, "absent"),
                   "Public": (None, "public_not_allowed")}
    forced = {r.name: r.status for r in N.resolve_kinds(names, principals, "group").collect()}
    assert (forced["a"], forced["b"]) == ("not_that_kind", "ok")


def test_reports_sort_as_readers_expect(frame):
    df = frame([("b", 1), ("a", 2), (None, 1), ("a", 1)], "target string, rank int")
    assert [tuple(r) for r in in_report_order(df, "triage").collect()] == [("a", 1), ("a", 2), ("b", 1), (None, 1)]
