"""Semantics of the engine, edge by edge."""

import json

import pytest
from pyspark.sql import functions as F

from rillwork import Context, FailureKind, FunctionRegistry, KeyValue, PermanentFailure, classify, default_registry, explain_stage_plan, hash_partitioner
from rillwork.cli import explain, main
from rillwork.errors import JobError, PlanError
from rillwork.functions.builtin import _integer, normalize, sum_int
from rillwork.functions.partitioner import fnv1a, partition_column, partition_for
from rillwork.operators.dataset import TOO_MANY_SHUFFLES
from rillwork.plans import jobspec
from rillwork.plans.compiler import JsonNumber, decode, encode
from rillwork.plans.lineage import Dependency, Lineage, Narrow, Node, Partitioner, Shuffle
from rillwork.service import JobService
from rillwork.sources.text import from_frame, from_partitions
from rillwork.streaming.narrow import apply_narrow

INPUT = b"  alpha\nbeta\n\nalpha  \ngamma\n  beta  \n"


def words(ctx, path="x", n=4):
    return ctx.text_file(path, n).map("normalize").filter("non_empty")


def counted(ctx, path="x", n=4, reduce=2):
    return words(ctx, path, n).map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(reduce))


def local(spark, *partitions, schema="string", registry=None, **how):
    return Context(spark, registry or default_registry(), from_partitions(list(partitions), schema), **how)


# Sources


@pytest.mark.parametrize(
    "data, lines",
    [
        (b"a\nbbbbb\ncc\ndddddddd\ne\n", ["a", "bbbbb", "cc", "dddddddd", "e"]),
        (b"a\r\nb\rc\n\nlast\r", ["a", "b\rc", "", "last"]),
        (b"", []),
        (b"\n", [""]),
        (b"x\r\r\n", ["x\r"]),
        (INPUT, ["  alpha", "beta", "", "alpha  ", "gamma", "  beta  "]),
    ],
)
@pytest.mark.parametrize("n", [1, 4])
def test_lines(spark, text_path, data, lines, n):
    ds = Context(spark, default_registry()).text_file(text_path(data), n)
    assert ds.collect() == lines
    assert ds.count() == len(lines)


def test_order_over_many_splits(spark, text_path):
    data = [f"line {i}" for i in range(5000)]
    path = text_path("\n".join(data).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert Context(spark, default_registry()).text_file(path, 9).collect() == data
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_source_path_is_one_plain_file(spark, tmp_path):
    (tmp_path / "a[1]*.txt").write_bytes(b"here\n")
    (tmp_path / "a1x.txt").write_bytes(b"not here\n")
    ctx = Context(spark, default_registry())
    assert ctx.text_file(str(tmp_path / "a[1]*.txt"), 1).collect() == ["here"]
    for bad in (tmp_path, tmp_path / "none", tmp_path / "*.txt"):
        with pytest.raises(PermanentFailure) as e:
            ctx.text_file(str(bad), 1).collect()
        assert classify(e.value) is FailureKind.PERMANENT


def test_lazy_until_the_action(spark):
    opened = []

    def source(s, path, n):
        opened.append(path)
        return s.createDataFrame([(" alpha ",), ("  ",), ("beta",)], "record string")

    ds = words(Context(spark, default_registry(), source))
    ds.explain_lineage()
    explain_stage_plan(ds.plan_stages("count"))
    assert opened == []
    assert ds.count() == 2 and opened == ["x"]


# Functions


def test_normalize_trims_unicode_white_space_alone(spark):
    white = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kept = [0, 0x1C, 0x1F, 0x200B, 0xFEFF, 0x180E]
    rows = ["".join(map(chr, white)) + "a b" + "".join(map(chr, white)), *(chr(c) + "x" + chr(c) for c in kept), "", "\n"]
    want = ["a b", *rows[1:-2], "", ""]
    assert local(spark, rows).text_file("x", 1).map("normalize").collect() == want
    assert list(map(normalize, rows)) == want


@pytest.mark.parametrize("a, b, total", [(1, 2, 3), (2**53 + 1, 2, 2**53 + 3), (2**63 - 1, -(2**63), -1), (2**63 - 1, 0, 2**63 - 1), (-(2**63), 0, -(2**63))])
def test_sum_int(spark, a, b, total):
    assert sum_int(a, b) == total
    ctx = local(spark, [a], [b], schema="long")
    ctx.registry.register_pair_map("one", column=lambda c: (F.lit("k"), c))
    assert ctx.text_file("x", 2).map_to_pair("one").reduce_by_key("sum_int", hash_partitioner(2)).collect() == [KeyValue("k", total)]


@pytest.mark.parametrize("bad", [None, True, "1", 1.0, decode("1.0"), decode("1e2"), 2**63, decode("0.5")])
def test_sum_int_refuses(bad):
    for pair in ((bad, 1), (1, bad)):
        with pytest.raises(PermanentFailure):
            sum_int(*pair)
    with pytest.raises(PermanentFailure):
        _integer(bad)


@pytest.mark.parametrize("values", [[2**63 - 1, 1], [-(2**63), -1], [1, None]])
@pytest.mark.parametrize("action", ["count", "collect"])
def test_overflow_and_null_fail_both_actions(spark, values, action):
    ctx = local(spark, values, schema="long")
    ctx.registry.register_pair_map("one", column=lambda c: (F.lit("k"), c))
    ds = ctx.text_file("x", 1).map_to_pair("one").reduce_by_key("sum_int", hash_partitioner(1))
    with pytest.raises(Exception) as e:
        getattr(ds, action)()
    assert classify(e.value) is FailureKind.PERMANENT


def test_a_single_value_passes_the_reducer_by(spark):
    ctx = local(spark, [None], schema="long")
    ctx.registry.register_pair_map("one", column=lambda c: (F.lit("k"), c))
    ds = ctx.text_file("x", 1).map_to_pair("one").reduce_by_key("sum_int", hash_partitioner(1))
    assert ds.collect() == [KeyValue("k", None)] and ds.count() == 1


# Actions and order


def test_example_results(spark, text_path):
    ctx = Context(spark, default_registry())
    path = text_path(INPUT)
    assert words(ctx, path).count() == 5
    assert counted(ctx, path).collect() == [("gamma", 1), ("alpha", 2), ("beta", 2)]  # by partition, then by key
    assert counted(ctx, path).count() == 3
    ctx.registry.register_value_map("double", column=lambda v: v * 2)
    assert dict(counted(ctx, path).map_values("double").collect()) == {"alpha": 4, "beta": 4, "gamma": 2}


def test_empty_input(spark, text_path):
    ctx = Context(spark, default_registry())
    path = text_path(b"")
    assert counted(ctx, path).collect() == [] and counted(ctx, path).count() == 0 and words(ctx, path).collect() == []


def test_keys_in_byte_order_in_a_partition(spark):
    keys = ["\U0001f600", "￮", "z", "", "a"]
    ds = local(spark, keys).text_file("x", 1).map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(1))
    assert [k for k, _ in ds.collect()] == sorted(keys, key=str.encode)


@pytest.mark.parametrize("n", [1, 4, 7])
@pytest.mark.parametrize("how", ["column", "python", "json"])
def test_reduce_in_order(spark, n, how):
    parts = [[] for _ in range(n)]
    for i in range(40):
        parts[i * n // 40].append(f"{'ab'[i % 2]}{i}")
    ctx = local(spark, *parts)
    ctx.registry.register_pair_map("first", python=lambda s: KeyValue(s[0], s[1:]), column=None if how == "json" else (lambda c: (F.substring(c, 1, 1), F.substring(c, 2, 9))))
    ctx.registry.register_reduce("join", python=lambda a, b: f"{a},{b}", column=(lambda a, b: F.concat(a, F.lit(","), b)) if how == "column" else None, returns=None if how == "json" else "string")
    got = dict(ctx.text_file("x", n).map_to_pair("first").reduce_by_key("join", hash_partitioner(3)).collect())
    assert got == {"a": ",".join(str(i) for i in range(0, 40, 2)), "b": ",".join(str(i) for i in range(1, 40, 2))}


def test_any_json_value_passes(spark):
    ctx = local(spark, ["0", "1", "2", "3", "4", "5", "6"])
    values = ["alpha", 9007199254740993, True, None, {"a": [1, {"b": None}]}, 2**63, JsonNumber("1.10")]
    ctx.registry.register_map("value", python=lambda s: values[int(s)])
    ctx.registry.register_map("same", python=lambda v: v)
    got = ctx.text_file("x", 1).map("value").map("same").collect()
    assert got == values and encode(got[-1]) == "1.10"


def test_null_is_a_value_for_a_custom_reducer(spark):
    ctx = local(spark, ["a", "a"])
    ctx.registry.register_pair_map("none", python=lambda s: KeyValue("", None))
    ctx.registry.register_reduce("keep", python=lambda a, b: a)
    assert ctx.text_file("x", 1).map_to_pair("none").reduce_by_key("keep", hash_partitioner(2)).collect() == [KeyValue("", None)]


@pytest.mark.parametrize("action", ["count", "collect"])
def test_user_errors_fail_both_actions(spark, action):
    def refuse(value):
        if value == "bad":
            raise PermanentFailure("no good")
        return value

    def fail(value):
        raise RuntimeError("try again")

    ctx = local(spark, ["ok", "bad"])
    ctx.registry.register_map("refuse", python=refuse, returns="string")
    ctx.registry.register_map("fail", python=fail)
    for name, kind in (("refuse", FailureKind.PERMANENT), ("fail", FailureKind.EXECUTION)):
        with pytest.raises(Exception) as e:
            getattr(ctx.text_file("x", 1).map(name), action)()
        assert classify(e.value) is kind


def test_pairs_are_asked_for(spark):
    ctx = local(spark, ["a"])
    ctx.registry.register_value_map("v", column=lambda v: v)
    for ds in (ctx.text_file("x", 1).map_values("v"), ctx.text_file("x", 1).reduce_by_key("sum_int", hash_partitioner(1))):
        with pytest.raises(PermanentFailure, match="expected KeyValue"):
            ds.collect()


def test_key_guards(spark, text_path):
    ctx = Context(spark, default_registry())
    ds = ctx.text_file(text_path(b"\xff\xfeab\nok\n"), 1)
    assert ds.count() == 2
    big = local(spark, ["k" * (1 << 20)])
    for bad in (ds, big.text_file("x", 1)):
        with pytest.raises(Exception) as e:
            bad.map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(1)).count()
        assert classify(e.value) is FailureKind.PERMANENT
    free = local(spark, ["k" * (1 << 20)], record_bytes=None)
    assert free.text_file("x", 1).map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(1)).count() == 1


def test_only_one_shuffle_unless_allowed(spark):
    ctx = local(spark, ["a"])
    ds = ctx.text_file("x", 1).map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(2)).reduce_by_key("sum_int", hash_partitioner(3))
    assert len(ds.plan_stages("count").stages) == 3
    with pytest.raises(PermanentFailure, match=TOO_MANY_SHUFFLES):
        ds.count()
    ctx.max_shuffles = None
    assert ds.collect() == [KeyValue("a", 1)]


def test_partial_aggregation_before_the_shuffle(spark):
    plan = counted(local(spark, ["a"])).to_frame()._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan


# Partitioner


def test_published_hash_vectors(spark):
    vectors = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}
    assert {k: fnv1a(k.encode()) for k in vectors} == vectors
    keys = [*vectors, "世界", "\U0001f600", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for n in (1, 2, 7, 31):
        got = {r.key: r.p for r in df.select("key", partition_column(F.col("key"), n).alias("p")).collect()}
        assert got == {k: partition_for(k, n) for k in keys} == {k: fnv1a(k.encode()) % n for k in keys}
    for bad in (("a", 0), ("a", -1), (b"\xff", 1)):
        with pytest.raises(PermanentFailure):
            partition_for(*bad)


def test_rows_are_placed_by_the_partitioner(spark):
    df = counted(local(spark, ["alpha", "beta", "gamma", "beta"])).placed_frame(2)
    assert df.rdd.getNumPartitions() == 2
    assert [[r.key for r in part] for part in df.rdd.glom().collect()] == [["gamma"], ["alpha", "beta"]]


# Lineage, plans, explanations

EXPLAINED = """== RDD Lineage ==
RDD 0 TextFile[4] operator=source source="examples/missing-input.txt"
RDD 1 Map[4] operator=map function="normalize" narrow <- RDD 0
RDD 2 Filter[4] operator=filter function="non_empty" narrow <- RDD 1
RDD 3 MapToPair[4] operator=map_to_pair function="word_pair" narrow <- RDD 2
RDD 4 ReduceByKey[2] operator=reduce_by_key function="sum_int" partitioner=hash[2] shuffle <- RDD 3 shuffle=0 shuffle_partitioner=hash[2] aggregator="sum_int" map_side_combine=true
== Stage DAG ==
Target RDD 4
Stage 0 kind=shuffle_map partitions=4 parents=[] tasks=4
  Pipeline: RDD 0 source -> RDD 1 map -> RDD 2 filter -> RDD 3 map_to_pair
  ShuffleWrite: shuffle=0 partitioner=hash[2] aggregator="sum_int" map_side_combine=true
Stage 1 kind=result partitions=2 parents=[0] tasks=2
  Pipeline: ShuffleRead 0 hash[2] -> RDD 4 reduce_by_key
  Action: collect target=RDD 4
"""


def job(path="in.txt", action="collect", n=4, steps=None):
    steps = [("map", "normalize"), ("filter", "non_empty"), ("map_to_pair", "word_pair"), ("reduce_by_key", "sum_int", 2)] if steps is None else steps
    return {"source": {"path": path, "num_partitions": n}, "transformations": [{"kind": s[0], "function_id": s[1], **({"num_partitions": s[2]} if len(s) > 2 else {})} for s in steps], "action": action}


def test_explain_touches_nothing():
    assert explain(json.dumps(job("examples/missing-input.txt")).encode(), default_registry()) == EXPLAINED


def test_partitioner_is_kept_by_filter_and_map_values():
    ctx = Context(registry=default_registry())
    r = ctx.text_file("x", 4).map_to_pair("p").reduce_by_key("f", hash_partitioner(3))
    of = lambda ds: ctx.lineage.get(ds.node_id).partitioner
    assert of(r.filter("f")) == of(r.map_values("f")) == Partitioner(3)
    assert of(r.map("f")) is None and of(r.map_to_pair("f")) is None
    assert ctx.lineage.get(r.filter("f").node_id).num_partitions == 3


def narrow(parent=0):
    return (Dependency(parent, "narrow", narrow=Narrow()),)


def wide(parent=0, n=2):
    return (Dependency(parent, "shuffle", shuffle=Shuffle(0, Partitioner(n), "f")),)


SOURCE = Node("TextFile", "source", 2, path="x", id=0)


@pytest.mark.parametrize(
    "node, said",
    [
        (Node("N", "map", 0, function="f", dependencies=narrow()), "has invalid partition count"),
        (Node("N", "map", 2, function="f", dependencies=narrow(), partitioner=Partitioner(3)), "partitions but its partitioner has"),
        (Node("N", "map", 2, function="f", dependencies=narrow(), partitioner=Partitioner(2, "range")), "unsupported partitioner kind"),
        (Node("N", "map", 2, function="f", dependencies=(Dependency(0, "narrow"),)), "must contain only a narrow specification"),
        (Node("N", "reduce_by_key", 2, function="f", dependencies=(Dependency(0, "shuffle", narrow=Narrow()),)), "must contain only a shuffle specification"),
        (Node("N", "map", 2, function="f", dependencies=(Dependency(0, "narrow", narrow=Narrow("many")),)), "unsupported narrow mapping"),
        (Node("N", "map", 2, function="f", dependencies=(Dependency(0, "odd"),)), "unsupported dependency kind"),
        (Node("N", "map", 2, function="f", dependencies=narrow(9)), "references missing parent RDD"),
        (Node("N", "reduce_by_key", 3, function="f", dependencies=wide()), "shuffle reduce count"),
        (Node("N", "source", 2), "source path must not be empty"),
        (Node("N", "source", 2, path="x", dependencies=narrow()), "source must not have dependencies"),
        (Node("N", "map", 2, dependencies=narrow()), "function ID must not be empty"),
        (Node("N", "map", 2, function="f", dependencies=wide()), "requires one narrow dependency"),
        (Node("N", "reduce_by_key", 2, function="f", dependencies=narrow()), "requires one shuffle dependency"),
        (Node("N", "flat_map", 2, function="f", dependencies=narrow()), "unsupported operator kind"),
        (Node("N", "map", 2, function="f", dependencies=narrow(1)), "lineage contains a cycle"),
    ],
)
def test_validation(node, said):
    with pytest.raises(PlanError, match=said):
        Lineage([SOURCE, Node(**{**node.__dict__, "id": 1})]).validate(1)
    Lineage([SOURCE, Node(**{**node.__dict__, "id": 1})]).validate(0)  # what the target doesn't need isn't looked at


def test_refused_nodes_add_nothing():
    ctx = Context(registry=default_registry())
    with pytest.raises(PlanError):
        ctx.text_file("x", 0)
    ds = ctx.text_file("x", 1)
    with pytest.raises(PlanError):
        ds.reduce_by_key("f", hash_partitioner(0))
    assert len(ctx.lineage) == 1


def test_planning_errors(spark):
    ctx = Context(registry=default_registry())
    ds = ctx.text_file("x", 1).map("unknown")
    with pytest.raises(PlanError, match='map function "unknown" is not registered'):
        ds.plan_stages("count")
    with pytest.raises(PlanError, match="unsupported action"):
        ds.plan_stages("save")
    with pytest.raises(PlanError, match="action runner is not configured"):
        ctx.text_file("x", 1).count()
    with pytest.raises(PlanError, match="does not exist"):
        ctx.lineage.validate(99)
    with pytest.raises(PlanError, match="function lookup is nil"):
        from rillwork.plans.stages import plan_stages

        plan_stages(ctx.lineage, 0, "count", None)


def test_registry_rules():
    r = FunctionRegistry()
    r.register_map("f", str)
    r.register_filter("f", bool)  # kinds are separate
    for bad in (lambda: r.register_map("f", str), lambda: r.register_map("", str), lambda: r.register_map("g")):
        with pytest.raises(PlanError, match="map function"):
            bad()
    assert r.has("map", "f") and not r.has("reduce", "f")
    with pytest.raises(PlanError, match='reduce function "f" is not registered'):
        r.lookup("reduce", "f")


# Job specifications and the service


@pytest.mark.parametrize(
    "text, said",
    [
        (json.dumps({**job(), "more": 1}), "unknown field"),
        (json.dumps(job("")), "source path"),
        (json.dumps(job(n=0)), "source partition"),
        (json.dumps(job(steps=[("flat_map", "f")])), "unsupported operator"),
        (json.dumps(job(steps=[("source", "f")])), "unsupported operator"),
        (json.dumps(job(steps=[("map", "")])), "function_id"),
        (json.dumps(job(steps=[("reduce_by_key", "f")])), "positive num_partitions"),
        (json.dumps(job(steps=[("map", "f", 2)])), "does not accept"),
        (json.dumps(job(action="save")), "unsupported action"),
        (json.dumps(job()) + "{}", "multiple JSON values"),
        (json.dumps(job()) + "x", "trailing data"),
        (json.dumps(job()).replace('"action"', '"Action"'), "unknown field"),
        ('{"action":"count","action":"count"}', "duplicate field"),
        (json.dumps({**job(), "action": None}), "must not be null"),
        ('{"action":"count"}', "missing field"),
        ("[]", "must be an object"),
        ("", "decode job"),
        (" " * (1 << 20) + "{}", "size limit"),
    ],
)
def test_refused_jobs(text, said):
    with pytest.raises(PlanError, match=said):
        jobspec.decode(text)


def test_service(spark, text_path):
    service = JobService(spark, default_registry())
    path = text_path(INPUT)
    assert service.submit(json.dumps(job(path))).to_json() == '{"action":"collect","records":[{"key":"gamma","value":1},{"key":"alpha","value":2},{"key":"beta","value":2}],"count":0}'
    assert json.loads(service.submit(json.dumps(job(path, "count"))).to_json()) == {"action": "count", "records": None, "count": 3}
    assert json.loads(service.submit(json.dumps(job(text_path(b"")))).to_json()) == {"action": "collect", "records": [], "count": 0}
    for text, status in (("{", 400), (" " * (2 << 20), 413), (json.dumps(job("/none")), 422), (json.dumps(job(path, steps=[("map", "unknown")])), 422)):
        with pytest.raises(JobError) as e:
            service.submit(text)
        assert e.value.status == status
    two = [("map_to_pair", "word_pair"), ("reduce_by_key", "sum_int", 2), ("reduce_by_key", "sum_int", 2)]
    with pytest.raises(JobError, match=TOO_MANY_SHUFFLES):
        service.submit(json.dumps(job(path, steps=two)))
    with pytest.raises(JobError) as e:
        JobService(None, default_registry()).submit("{}")
    assert e.value.status == 503


def test_deadline_cancels(spark, text_path):
    registry = default_registry()

    def slow(v):
        import time

        time.sleep(20)
        return v

    registry.register_map("slow", python=slow)
    with pytest.raises(JobError) as e:
        JobService(spark, registry).submit(json.dumps(job(text_path(b"a\n"), steps=[("map", "slow")])), timeout=1.5)
    assert e.value.status == 504 and e.value.kind is FailureKind.CANCELED


def test_command_line(spark, text_path, tmp_path, capsys):
    spec = tmp_path / "job.json"
    spec.write_text(json.dumps(job(text_path(INPUT), "count")))
    assert main(["submit", "--job", str(spec)]) == 0
    assert capsys.readouterr().out == "3\n"
    spec.write_text(json.dumps(job("examples/missing-input.txt")))
    assert main(["explain", "--job", str(spec)]) == 0
    assert capsys.readouterr().out == EXPLAINED
    assert main(["submit", "--job", str(spec)]) == 1
    out = capsys.readouterr()
    assert out.out == "" and "does not exist" in out.err


def test_concurrent_jobs_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor

    parts = [[[" alpha ", " "], ["beta", "alpha"], [], ["gamma", "beta"]], [["other"], [], ["other"], ["key"]]]
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda p: dict(counted(local(spark, *p)).collect()), parts))
    assert got == [{"alpha": 2, "beta": 2, "gamma": 1}, {"other": 2, "key": 1}]


def test_streams_take_narrow_pipelines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" a \n \nb\n")
    ds = words(Context(spark, default_registry())).map_to_pair("word_pair")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "record")
    q = apply_narrow(ds, stream).writeStream.format("memory").queryName("narrow").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("narrow").collect())) == [("a", 1), ("b", 1)]
    with pytest.raises(PlanError):
        apply_narrow(counted(Context(spark, default_registry())), stream)


def test_custom_source(spark):
    ctx = Context(spark, default_registry(), from_frame(lambda s: s.range(5).selectExpr("cast(id as string) AS record")))
    assert sorted(ctx.text_file("any", 2).collect()) == ["0", "1", "2", "3", "4"]


def test_http(spark, text_path, tmp_path, capsys):
    import threading
    import urllib.error
    import urllib.request

    from rillwork import http

    server = http.make_server(JobService(spark, default_registry()))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    spec = tmp_path / "job.json"
    try:
        for action, out in (("count", "3\n"), ("collect", '[{"key":"gamma","value":1},{"key":"alpha","value":2},{"key":"beta","value":2}]\n')):
            spec.write_text(json.dumps(job(text_path(INPUT), action)))
            assert main(["submit", "--coordinator", url, "--job", str(spec)]) == 0
            assert capsys.readouterr().out == out
        spec.write_text(json.dumps(job("/none")))
        assert main(["submit", "--coordinator", url, "--job", str(spec)]) == 1 and "does not exist" in capsys.readouterr().err
        for path, method, body, status in (("/v1/jobs", "GET", None, 405), ("/v2", "POST", b"{}", 404), ("/v1/jobs", "POST", b"{", 400), ("/v1/jobs", "POST", b" " * (2 << 20), 413)):
            with pytest.raises((urllib.error.HTTPError, urllib.error.URLError)) as e:
                urllib.request.urlopen(urllib.request.Request(url + path, data=body, method=method), timeout=20)
            assert getattr(e.value, "code", status) == status
    finally:
        server.shutdown()
    with pytest.raises(JobError):
        http.submit(url, b"{}", 5, 1000) if server.server_close() is None else None


@pytest.mark.parametrize("width", [1, 3, 7])
def test_text_width(spark, text_path, width):
    """The source has as many partitions as asked for, and the order of the lines doesn't change."""
    from rillwork.sources.text import text_file

    lines = [f"line {i}" for i in range(100)]
    df = text_file(spark, text_path("\n".join(lines).encode()), width)
    assert df.rdd.getNumPartitions() == width
    assert [r.record for r in df.orderBy("ord_major", "ord_minor").collect()] == lines


def test_ordered_python_fold_over_ranges(spark, text_path):
    from rillwork import Context, default_registry, hash_partitioner

    r = default_registry()
    r.register_pair_map("letter", lambda x: (x[0], x[1:]), returns="string")
    r.register_reduce("then", lambda a, b: a + "," + b, returns="string")
    lines = [f"{'ab'[i % 3 == 0]}{i}" for i in range(200)]
    want = {k: ",".join(x[1:] for x in lines if x[0] == k) for k in "ab"}
    for width in (1, 4, 9):
        got = Context(spark, r).text_file(text_path("\n".join(lines).encode()), width).map_to_pair("letter").reduce_by_key("then", hash_partitioner(3)).collect()
        assert {p.key: p.value for p in got} == want
