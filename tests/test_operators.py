from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakecairn.errors import CannotReplaceRootMap, DanglingAddress, DuplicateKey, InvalidInput, UndiffableType, UnmergeableType, WrongType
from lakecairn.operators import chunking, crdt, history, maps, paths, sets, tree
from lakecairn.operators.listing import listing
from lakecairn.plans import q_tree
from lakecairn.plans.catalogue import ORACLES
from tests.oracle import connect, same

SHELVES = [f"shelf{i}/{box}" for i in (1, 2, 10) for box in ("", "pens", "pens/red", "pens.old", "ink")]


def items(spark, d):
    return spark.createDataFrame(sorted(d.items()), "k string, v string")


def root(nodes):
    return tree.root(nodes).first()["root"]


def test_six_ranges(spark):
    m = spark.range(8).withColumnRenamed("id", "k")
    get = lambda **b: [r.k for r in maps.scan(m, "k", ordered=True, **b).collect()]
    assert get(start=3, end=5) == [3, 4] and get(start=3) == [3, 4, 5, 6, 7] and get() == list(range(8))
    assert get(start=3, end=5, end_closed=True) == [3, 4, 5] and get(end=5) == [0, 1, 2, 3, 4] and get(end=5, end_closed=True) == [0, 1, 2, 3, 4, 5]
    assert get(start=3, end=5, start_open=True) == [4]


def test_range_reaches_the_files(spark):
    m = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    plan = maps.scan(m, "o_orderkey", 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,3)" in plan and "o_totalprice" not in plan


def test_changes(spark):
    m = spark.createDataFrame([(i, str(i)) for i in range(6)], "k long, v string")
    c = spark.createDataFrame([(1, 0, "remove", None), (2, 7, "insert", "7"), (3, 7, "insert", "77"), (4, 1, "insert", "x"), (5, 1, "remove", None), (6, 2, "remove", None), (7, 2, "insert", "two")], "seq long, k long, op string, v string")
    assert {r.k: r.v for r in maps.apply(m, c, ["k"], "seq").collect()} == {2: "two", 3: "3", 4: "4", 5: "5", 7: "77"}
    with pytest.raises(DuplicateKey):
        maps.require_unique(c, ["k"])
    assert maps.require_unique(m, ["k"]) is m
    d = {r.k: (r.change, r.old_v, r.new_v) for r in maps.diff(m, maps.apply(m, c, ["k"], "seq"), ["k"]).collect()}
    assert d == {0: ("removed", "0", None), 1: ("removed", "1", None), 2: ("changed", "2", "two"), 7: ("added", None, "77")}


def test_listing(spark):
    df = spark.createDataFrame([(k,) for k in SHELVES], "key string")
    get = lambda p, d=None: [r.key for r in listing(df, "key", p, d).orderBy("key").collect()]
    assert get("") == get("shelf", "") == sorted(SHELVES) and get("drawer") == get("drawer", "/") == []
    assert get("", "/") == get("shelf", "/") == ["shelf1/", "shelf10/", "shelf2/"]
    assert get("shelf10/pens") == ["shelf10/pens", "shelf10/pens.old", "shelf10/pens/red"]
    assert get("shelf2/", "/") == ["shelf2/", "shelf2/ink", "shelf2/pens", "shelf2/pens.old", "shelf2/pens/"]
    assert get("shelf2/p", "ens") == ["shelf2/pens"]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab/", min_size=1, max_size=6), max_size=12), st.text("ab/", max_size=2), st.sampled_from(["/", "ab"]))
def test_listing_equals_plain_grouping(spark, keys, prefix, delimiter):
    want = set()
    for k in keys:
        if k.startswith(prefix):
            head, found, _ = k[len(prefix) :].partition(delimiter)
            want.add(prefix + head + delimiter if found else k)
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {r.key for r in listing(df, "key", prefix, delimiter).collect()} == want


@pytest.mark.parametrize("n", [1, 20, 200, 2000])
def test_tree_round_trip(spark, n):
    base = {f"{i:06d}": str(10 * i) for i in range(n)}
    nodes = tree.build(items(spark, base))
    assert {r.k: r.v for r in tree.scan(nodes).collect()} == base
    assert tree.get(nodes, "000000").first().v == "0" and tree.get(nodes, "x").isEmpty()
    shuffled = items(spark, base).orderBy(F.hash("k")).repartition(3)
    assert root(tree.build(shuffled)) == root(nodes)


@pytest.mark.parametrize(("name", "level"), [("Customer 25", 1), ("Customer 36", 2), ("Customer 175333", 5)])
def test_levels_that_do_not_shrink(spark, tmp_path, name, level):
    """The first of two nodes ends its block on all levels below this one; roots by build and by update are the SQL's."""
    spark.createDataFrame([(1, name), (2, "x")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    con = connect(str(tmp_path))
    assert same(q_tree.tree_root(spark, str(tmp_path)), con, ORACLES["tree_root"]) == 1
    k = "000000000001"
    nodes = tree.update(tree.build(items(spark, {k: "before", "000000000002": "x"})), spark.createDataFrame([(k, "insert", name)], "k string, op string, v string"))
    assert [tuple(r) for r in tree.root(nodes).collect()] == con.sql(ORACLES["tree_root"]).fetchall() and tree.root(nodes).first().level == level
    with pytest.raises(ValueError, match="bits"):
        tree.build(items(spark, {k: "x"}), bits=0)


def test_blocks_in_ranges_equal_one_pass(spark):
    rows = items(spark, {f"{i:06d}": str(i) for i in range(500)}).withColumn("e", tree.ends_block(F.col("k"), F.col("v")))
    one, many = (tree.block_ids(rows, "k", "e", partitions=p).orderBy("k").collect() for p in (None, 7))
    assert one == many


def test_update_equals_build(spark):
    rnd = random.Random(4)
    content = {f"{i:04d}": str(i) for i in range(150)}
    nodes = tree.build(items(spark, content))
    for _ in range(4):
        changes = {}
        for _ in range(rnd.choice([1, 3, 12])):
            k = f"{rnd.randrange(180):04d}"
            changes[k] = None if rnd.random() < 0.5 else str(rnd.randrange(1000))
        content = {k: v for k, v in (content | changes).items() if v is not None}
        rows = [(k, "remove" if v is None else "insert", v) for k, v in changes.items()]
        before = {r.addr for r in nodes.filter("level = 0").collect()}
        nodes = tree.update(nodes, spark.createDataFrame(rows, "k string, op string, v string"))
        assert root(nodes) == root(tree.build(items(spark, content)))
        fresh = {r.addr for r in nodes.filter("level = 0").collect()} - before
        assert len(fresh) <= 2 * len(rows) + 1


def test_removing_and_restoring_gives_the_first_root(spark):
    content = {str(i): str(i) for i in range(7)}
    first = tree.build(items(spark, content))
    gone = tree.update(first, spark.createDataFrame([(k, "remove", None) for k in content], "k string, op string, v string"))
    assert gone.count() == 1 and gone.first().n == 0 and root(gone) == root(tree.empty(spark))
    back = tree.update(gone, spark.createDataFrame([(k, "insert", v) for k, v in content.items()], "k string, op string, v string"))
    assert root(back) == root(first) and tree.build(items(spark, content).limit(0)).first().n == 0


def test_block_of_and_neighbours(spark):
    leaves = tree.blocks(items(spark, {f"{i:06d}": str(i) for i in range(0, 400, 2)}), 0)
    firsts = sorted((r.first_key, r.block) for r in leaves.collect())
    got = tree.block_of(spark.createDataFrame([(f"{i:06d}",) for i in range(-1, 401)], "q string"), "q", leaves).collect()
    for r in got:
        assert r.block == max((b for f, b in firsts if f <= r.q), default=None)
    for partitions in (None, 5):
        after = {r.first_key: r.next_key for r in tree.neighbours(leaves, partitions).collect()}
        assert after == {a[0]: b[0] if b else None for a, b in zip(firsts, [*firsts[1:], None])}


def test_sets(spark):
    v = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    s = sets.create(v("a", "b", "a", None), "value")
    assert {r.value for r in s.collect()} == {"a", "b"}
    many = sets.create(spark.range(200).select(F.col("id").cast("string").alias("v")), "v")
    assert sorted(sets.ordered(many).collect()) == sorted(sets.ordered(many, 6).collect())
    assert {r.value for r in sets.union(s, sets.create(v("c"), "value")).collect()} == {"a", "b", "c"}
    assert {r.value for r in sets.except_(s, v("b")).collect()} == {"a"}
    ops = spark.createDataFrame([(0, "insert", "x"), (1, "remove", "x"), (2, "remove", "a"), (3, "insert", "y"), (4, "insert", "y")], "seq long, op string, value string")
    assert {r.value for r in sets.update(s, ops).collect()} == {"b", "y"}
    bag = sets.positions(v("z", "a", "z").withColumn("i", F.monotonically_increasing_id()), "i").drop("i")
    both = sets.append(bag, bag)
    assert [r.value for r in sets.read(both).collect()] == [r.value for r in sets.read(bag).collect()] * 2
    with pytest.raises(InvalidInput):
        sets.one_kind(v("leaf", "branch"), "value", "leaf")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), max_size=5), min_size=3, max_size=3))
def test_counter_merge_laws(spark, states):
    a, b, c = (spark.createDataFrame([("c", r, n) for r, n in dict(s).items()], "counter string, rid int, n int") for s in states)
    get = lambda df: sorted((r.rid, r.n) for r in df.collect())
    assert get(crdt.merge(a, b)) == get(crdt.merge(b, a))
    assert get(crdt.merge(crdt.merge(a, b), c)) == get(crdt.merge(a, crdt.merge(b, c)))
    assert get(crdt.merge(a, a)) == get(a)


def test_counter_sequence_and_clocks(spark):
    ops = spark.createDataFrame([("c", 0)], "counter string, rid int")
    one = crdt.increments(ops, "counter", "rid")
    assert crdt.value(one).first().value == 1
    three = spark.createDataFrame([("c", 0, 1), ("c", 1, 2)], "counter string, rid int, n long")
    assert crdt.value(crdt.merge(one, three)).first().value == 3 and crdt.get(three, "c", 1).first().n == 2
    assert crdt.pn_value(one, three).first().value == -2
    clock = lambda *xs: spark.createDataFrame([("k", r, n) for r, n in xs], "clock string, rid int, n int")
    order = lambda x, y: crdt.compare_clocks(clock(*x), clock(*y)).first().ordering
    assert order([(0, 1)], [(0, 1)]) == "equal" and order([(0, 1)], [(0, 1), (1, 1)]) == "before"
    assert order([(0, 2)], [(0, 1)]) == "after" and order([(0, 2)], [(0, 1), (1, 1)]) == "concurrent"
    with pytest.raises(UnmergeableType):
        crdt.Opaque().merge("a", "b")
    with pytest.raises(UndiffableType):
        crdt.Opaque().diff("a", "b")
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id").repartition(5)
    assert {r.g: r.id for r in crdt.merge_by(df, ["g"], "id", crdt.MaxRegister()).collect()} == {0: 99, 1: 97, 2: 98}


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["stage", "commit"]), min_size=1, max_size=10))
def test_workspace_replay_equals_a_state_machine(spark, actions):
    want, staged, commit = [], None, None
    for i, a in enumerate(actions):
        error = None
        if a == "stage":
            staged = f"a{i}"
        elif staged is None:
            error = "CommitEmptyStage"
        else:
            commit, staged = f"a{i}", None
        status = ("init_staged" if commit is None else "staged") if staged else ("init" if commit is None else "clean")
        want.append((status, staged, commit, error))
    ops = spark.createDataFrame([("w", i, a, f"a{i}") for i, a in enumerate(actions)], "ws string, i int, action string, addr string")
    got = history.replay(ops, "ws", ["i"]).orderBy("i").collect()
    assert [(r.status, r.staged, r["commit"], r.error) for r in got] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_long_logs_over_ranges_equal_one_task(spark, seed):
    """Logs that go over several ranges, and ranges that hold several logs."""
    rnd = random.Random(seed)
    rows = [(rnd.choice("aaaaab"), i, rnd.choice(["stage", "stage", "commit"]), rnd.choice(["x", "y", None])) for i in range(300)] + [("c", 1, "commit", "x"), ("d", 1, "stage", None)]
    ops = spark.createDataFrame(rows, "ws string, i int, action string, addr string").repartition(5)
    both = lambda f: [sorted(map(str, f(hot).collect())) for hot in (False, True)]
    for f in (
        lambda hot: history.link(ops, "ws", ["i"], hot=hot),
        lambda hot: history.changed(ops, "ws", ["i"], "addr", hot=hot),
        lambda hot: history.tips(ops, ["ws"], ["i"], "addr", hot=hot),
        lambda hot: history.replay(ops, "ws", ["i"], hot=hot),
    ):
        one, many = both(f)
        assert one == many and len(one) > 50


def test_new_versions_along_a_path(spark):
    entries = spark.createDataFrame([("", "a", "m1"), ("", "z", "v0"), ("m1", "b", "m2"), ("m1", "y", "v1"), ("m2", "c", "v")], "map string, key string, child string")
    new, root_ = paths.update(entries, ["a", "b", "c"], "w")
    walk = lambda at, *keys: walk({(r.map, r.key): r.child for r in new.collect()}[at, keys[0]], *keys[1:]) if keys else at
    assert walk(root_, "a", "b", "c") == "w" and walk(root_, "z") == "v0" and walk(root_, "a", "y") == "v1"
    again, same = paths.update(entries, ["a", "b", "c"], "w")
    assert same == root_ != paths.update(entries, ["a", "b", "c"], "v")[1]
    made, _ = paths.update(entries, ["new", "k"], "1")
    assert made.count() == 4  # the new map, and the root's three entries
    asked = spark.createDataFrame([(1, "", ["z", "b"])], "path_id int, root string, path array<string>")
    value = lambda c: c.startswith("v")
    with pytest.raises(WrongType):
        paths.require_maps(paths.resolve(entries, asked, 2), 2, value)
    with pytest.raises(DanglingAddress):
        paths.require_children(entries.filter("map <> 'm2'"), lambda c: c.startswith("m"))
    assert paths.require_children(entries, lambda c: c.startswith("m")) is entries


def test_paths(spark):
    entries = spark.createDataFrame([("", "a", "m1"), ("m1", "b", "m2"), ("m2", "c", "v")], "map string, key string, child string")
    asked = spark.createDataFrame([(1, "", ["a", "b", "c"]), (2, "", ["a", "x", "c"]), (3, "", [])], "path_id int, root string, path array<string>")
    got = {r.path_id: (r.child_0, r.child_1, r.child_2) for r in paths.resolve(entries, asked, 3).collect()}
    assert got == {1: ("m1", "m2", "v"), 2: ("m1", None, None), 3: (None, None, None)}
    with pytest.raises(CannotReplaceRootMap):
        paths.insert(entries, [], "v")
    a, b = paths.insert(entries, ["n", "k"], "1"), paths.insert(paths.insert(entries, ["n", "k"], "0"), ["n", "k"], "1")
    assert sorted(a.collect()) == sorted(b.collect()) and sorted(paths.address(a).collect()) == sorted(paths.address(b).collect())


def test_chunks_round_trip_and_stay_put(spark):
    rnd = random.Random(2)
    data = bytes(rnd.randrange(256) for _ in range(60_000))
    ends = chunking.cut_points(data, 256, 1024, 4096)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= 4096 and min(sizes[:-1]) >= 256 and 600 < sum(sizes) / len(sizes) < 2000
    moved = chunking.cut_points(b"xyz" * 30 + data, 256, 1024, 4096)
    pieces = lambda d, e: {d[a:b] for a, b in zip([0, *e], e)}
    assert len(pieces(data, ends) - pieces(b"xyz" * 30 + data, moved)) <= 4
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "id long, b binary")
    cut = chunking.chunks(df, "id", "b", 256, 1024, 4096)
    back = {r.key: bytes(r.bytes) for r in chunking.assemble(chunking.index(cut), chunking.blobs(cut)).collect()}
    assert back == {1: data, 2: b""}
