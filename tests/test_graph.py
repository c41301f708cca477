"""Closures: diamonds, cycles, flags, empty input; checked against path enumeration."""

import random

from estate import session
from estate.operators import roles as R
from estate.plans.closure import closure

EDGE = "member string, role string, inherit boolean"


def brute(edges):
    """Shortest depth, smallest last node and flag by walking states, one node at a time."""
    out = {}
    step = {}
    for a, b, f in edges:
        if a != b:
            step.setdefault(a, {})
            step[a][b] = step[a].get(b, False) or f
    for start in {e[0] for e in edges}:
        seen, layer, depth = {}, {(start, True)}, 0
        known = {(start, True)}
        while layer:
            depth += 1
            after = set()
            for at, flag in layer:
                for to, f in step.get(at, {}).items():
                    if to == start:
                        continue
                    if to not in seen:
                        seen[to] = [depth, at, False]
                    if seen[to][0] == depth:
                        seen[to][1] = min(seen[to][1], at)
                    state = (to, flag and f)
                    seen[to][2] = seen[to][2] or state[1]
                    if state not in known:
                        known.add(state)
                        after.add(state)
            layer = after
        for to, (d, via, flag) in seen.items():
            out[start, to] = (d, via, flag)
    return out


def as_dict(df):
    return {(r.node, r.reached): (r.depth, r.via, r.flag) for r in df.collect()}


def test_diamond_flag_comes_from_any_path(frame):
    edges = [("u", "a", False), ("u", "b", True), ("a", "top", True), ("b", "m", True), ("m", "top", True)]
    got = as_dict(closure(frame(edges, EDGE), "member", "role", "inherit"))
    assert got["u", "top"] == (2, "a", True)
    assert got == brute(edges)


def test_cycle_ends_and_no_node_reaches_itself(frame):
    edges = [("a", "b", True), ("b", "c", True), ("c", "a", True), ("a", "a", True)]
    got = as_dict(closure(frame(edges, EDGE), "member", "role", "inherit"))
    assert ("a", "a") not in got
    assert got == brute(edges)


def test_random_graphs_match_brute_force(frame):
    rng = random.Random(7)
    for size in (12, 25):
        edges = [(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}", rng.random() < 0.6)
                 for _ in range(size * 2)]
        got = as_dict(closure(frame(edges, EDGE), "member", "role", "inherit"))
        assert got == brute(edges)


def test_given_starts_make_only_their_pairs(frame, spark):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}", rng.random() < 0.6) for _ in range(30)]
    starts = frame([("n3",), ("n4",), ("n4",), ("elsewhere",), (None,)], "name string")
    before = set(session._MADE)
    got = as_dict(closure(frame(edges, EDGE), "member", "role", "inherit", starts))
    assert got == {k: v for k, v in brute(edges).items() if k[0] in ("n3", "n4")}
    (root,) = set(session._MADE) - before
    rounds = spark.read.parquet(f"{root}/round-*")
    assert {r.node for r in rounds.select("node").distinct().collect()} <= {"n3", "n4"}


def test_deep_chain(frame):
    edges = [(f"n{i:02}", f"n{i + 1:02}", i != 20) for i in range(24)]
    got = as_dict(closure(frame(edges, EDGE), "member", "role", "inherit"))
    assert got == brute(edges)


def test_no_edges(frame):
    assert closure(frame([], EDGE), "member", "role", "inherit").count() == 0


def test_descendants_are_inverted_ancestors(frame, rows):
    edges = frame([("a", "b", True), ("b", "c", False), ("d", "b", True)], EDGE)
    up = rows(R.ancestors(edges), "role", "member", "depth", "inherit")
    down = rows(R.descendants(edges), "role", "member", "depth", "inherit")
    assert up == down


def test_effective_privileges_keep_public_apart(frame, rows):
    edges = frame([("u", "team", True), ("u", "audit", False)], EDGE)
    roles = frame([("u",), ("team",), ("audit",)], "role string")
    acl = frame([("schema", "s", "team", "USAGE", "x", False), ("schema", "s", "audit", "CREATE", "x", False),
                 ("schema", "p", None, "USAGE", "x", False)],
                "scope string, object_name string, grantee string, privilege string, grantor string, grantable boolean")
    holders = R.privilege_closure(roles, R.ancestors(edges), public=False)
    got = rows(R.effective_privileges(holders, acl), "role", "via", "object_name", "privilege")
    assert ("u", "team", "s", "USAGE") in got
    assert ("u", "audit", "s", "CREATE") not in got
    assert got.count(("public", "public", "p", "USAGE")) == 1
    assert len(got) == 4


def test_direct_only_skips_ancestors(frame, rows):
    roles = frame([("u",)], "role string")
    assert rows(R.privilege_closure(roles)) == [("u", "public"), ("u", "u")]


def test_rounds_are_the_logarithm_of_the_depth(frame, monkeypatch):
    from estate.plans import closure as C

    calls = []
    real = C._Known.append
    monkeypatch.setattr(C._Known, "append", lambda self, *a: calls.append(1) or real(self, *a))
    size = 130
    ring = [(f"n{i:03}", f"n{(i + 1) % size:03}", i != 5) for i in range(size)]
    got = as_dict(closure(frame(ring, EDGE), "member", "role", "inherit"))
    # One write of the edges and eight doublings reach 129 steps round the ring.
    assert len(calls) <= 9
    assert len(got) == size * (size - 1)
    for start in (0, 7, 129):
        for steps in (1, 2, 64, 100, 129):
            to = (start + steps) % size
            passed = {(start + i) % size for i in range(steps)}
            assert got[f"n{start:03}", f"n{to:03}"] == (steps, f"n{(to - 1) % size:03}", 5 not in passed)


def test_known_pairs_are_not_shuffled_to_be_looked_up(spark, frame):
    from estate.plans import closure as C
    from estate.session import scratch_path

    edges = frame([(f"n{i}", f"n{i + 1}", False, 1, f"n{i}") for i in range(40)],
                  "node string, reached string, clean boolean, depth int, via string")
    known = C._Known(spark, scratch_path(spark, "known"), edges.schema)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known.append(edges, C.F.lit(True))
        known.append(edges.limit(0), C.F.lit(True))
        fresh = C._fresh(C._extend(known.read(), known.read()), known.read())
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        # Of the anti join only: the known side is the scan under its sort, nothing between.
        known_side = plan[plan.index("LeftAnti"):].split("\n   :- ")[1].split("\n   +- ")[1]
        assert "Exchange" not in known_side and "Bucketed: true" in known_side
        assert fresh.count() == 39
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        known.close()


def test_walks_and_doubling_agree(frame):
    rng = random.Random(3)
    edges = frame([(f"n{rng.randrange(18)}", f"n{rng.randrange(18)}", rng.random() < 0.5) for _ in range(40)], EDGE)
    everyone = frame([(f"n{i}",) for i in range(18)], "name string")
    assert as_dict(closure(edges, "member", "role", "inherit", everyone)) == as_dict(
        closure(edges, "member", "role", "inherit"))


def test_flags_that_are_null_do_not_pass(frame):
    got = as_dict(closure(frame([("a", "b", None), ("b", "c", True)], EDGE), "member", "role", "inherit"))
    assert got == {("a", "b"): (1, "a", False), ("b", "c"): (1, "b", True), ("a", "c"): (2, "b", False)}


HOLDER = "role string, holder string"
GRANT = ("scope string, object_name string, grantee string, privilege string, grantor string, "
         "grantable boolean")


def test_a_group_most_roles_belong_to_is_split_among_tasks(spark, frame):
    from pyspark.sql import functions as F

    from estate.plans.shapes import heavy_keys, skewed_join

    tasks = 8
    holders = frame([(f"u{i}", "everyone" if i % 10 else f"g{i % 70}") for i in range(4000)] + [("x", None)], HOLDER)
    grants = frame([(g, f"t{i}") for g in ("everyone", "g0", "g10", "nobody") for i in range(5)], "holder string, object string")
    heavy = {r.holder: r.pieces for r in heavy_keys(holders, "holder", tasks).collect()}
    assert heavy == {"everyone": 8}
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k in keep:
        spark.conf.set(k, "false" if "adaptive" in k else "-1")
    try:
        joined = skewed_join(holders, grants, "holder", tasks)
        plain = holders.join(grants, "holder")
        share = {}
        for name, df in (("split", joined), ("plain", plain)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            share[name] = max(sizes) / sum(sizes)
        assert share["plain"] > 0.9 and share["split"] < 0.5
        assert sorted(map(tuple, joined.select("role", "holder", "object").collect())) == sorted(
            map(tuple, plain.select("role", "holder", "object").collect()))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_privileges_of_nobody(frame):
    held = R.effective_privileges(frame([], HOLDER), frame([("schema", "s", "a", "USAGE", "x", False)], GRANT))
    assert held.count() == 0


def test_rounds_leave_no_hot_role_to_one_task(frame, monkeypatch):
    from estate.plans import closure as C

    plans = []
    monkeypatch.setattr(C, "_fresh", lambda paths, known, of=C._fresh: plans.append(
        paths._jdf.queryExecution().optimizedPlan().toString()) or of(paths, known))
    edges = [(f"m{i}", "hub", i % 2 == 0) for i in range(200)] + [("hub", "top", True), ("top", "all", True)]
    for limit, hint in ((10, "strategy=merge"), (1000, "strategy=broadcast")):
        plans.clear()
        monkeypatch.setattr(C, "BROADCAST_ROWS", limit)
        got = as_dict(closure(frame(edges, EDGE), "role", "member", "inherit"))
        assert got == brute([(b, a, f) for a, b, f in edges])
        assert plans and hint in plans[0]


def test_reach_is_grouped_once_for_privileges(frame, rows):
    edges = frame([("u", "g", True), ("g", "top", True)], EDGE)
    roles = frame([("u", True), ("g", False)], "role string, can_login boolean")
    acl = frame([("schema", "s", "top", "USAGE")], "scope string, object_name string, grantee string, privilege string")
    held = R.effective_privileges(R.privilege_closure(roles, R.ancestors(edges), public=False), acl)
    assert rows(held, "role", "via") == [("g", "top"), ("u", "top")]
    assert not [f for f in held.inputFiles() if "round-pairs" in f]
    relations = frame([], "target string, schema_name string, owner string, relkind string")
    namespaces = frame([], "target string, schema_name string, owner string")
    report = R.describe_roles(roles, edges, acl, relations, namespaces)
    assert report.where("section = 'privileges'").count() == 2
    assert not [f for f in report.inputFiles() if "round-pairs" in f]
