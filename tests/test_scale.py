"""Properties that matter at scale: hot keys, order of the input, partition counts, and plan shapes."""

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperflow import scale
from paperflow.operators import linkage as L
from paperflow.operators import messages as M
from paperflow.plans import QUERIES
from paperflow.session import tune


def hot(spark, n=4000):
    """Half of the rows belong to one key."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 1013).alias("v"))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bucketed_windows_equal_plain_windows(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("id")
    bucket = scale.block("id", 100)
    assert same(scale.numbered(df, ["k"], ["id"], bucket, "n").select("id", "n"), df.select("id", F.row_number().over(w).alias("n")))
    near = scale.neighbour(df, ["k"], ["id"], bucket, ["v"], "p").select("id", F.col("p.v").alias("p"))
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in df.select("id", F.lag("v").over(w)).collect()}
    after = scale.neighbour(df, ["k"], ["id"], bucket, ["v"], "p", following=True).select("id", F.col("p.v").alias("p"))
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in df.select("id", F.lead("v").over(w)).collect()}


def test_first_by_and_order_statistics(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    assert same(scale.first_by(df, ["k"], ["v", "id"]).select("k", "id"), df.withColumn("n", F.row_number().over(w)).where("n = 1").select("k", "id"))
    stats = {r.k: (r.low, r.high) for r in scale.order_statistics(df, ["k"], "v", {"low": F.floor((F.col("n") - 1) / 4), "high": F.col("n") - 1}, 10.0).collect()}
    want = {r.k: sorted(r.vs) for r in df.groupBy("k").agg(F.collect_list("v").alias("vs")).collect()}
    assert stats == {k: (vs[(len(vs) - 1) // 4], vs[-1]) for k, vs in want.items()}


def test_page_text_is_joined_in_order(spark):
    lines = spark.createDataFrame([("p", i, f"w{i}" if i % 3 else "") for i in range(1000)], "k string, n int, t string")
    got = scale.joined_text(lines.repartition(7), ["k"], "n", "t").first()["t"]
    assert got == " ".join(f"w{i}" if i % 3 else "" for i in range(1000))


def test_salted_join_is_a_join(spark):
    df, names = hot(spark), spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name")).where("k <> 3")
    for how in ("left", "inner"):
        assert {tuple(r) for r in scale.salted_join(df, names, ["k"], how, ["id"]).select("id", "name").collect()} == {tuple(r) for r in df.join(names, "k", how).select("id", "name").collect()}


def test_lookups_that_grow_do_not_pass_the_driver(spark):
    for name in ("m2_classify_inbound", "m3_webhook_summary", "m11_outbound_queue", "r16_queue_view"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        joins = [line for line in plan.toString().splitlines() if "_salt#" in line and "Join" in line]
        assert joins and all("rightHint=(strategy=merge)" in line for line in joins), (name, joins)


def test_recognised_lines_are_not_shuffled(spark):
    from paperflow.plans import layout
    from paperflow.plans.registry import Tables

    plan = layout.straight(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [document_id" not in plan and plan.count("Exchange hashpartitioning(document_id") == plan.count("REPARTITION_BY_COL")


def test_a_task_prints_a_bounded_number_of_pages(spark, monkeypatch):
    from paperflow.plans import forms
    from paperflow.plans.registry import Tables

    monkeypatch.setattr(forms, "PRINTED", 100, raising=False)
    t = Tables(tune(spark), "/root/testdata/sf0.001")
    plan = forms.ocr_lines(t)._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"page_ref#\d+, (\d+)\), REPARTITION_BY_COL", plan)
    assert int(dealt[1]) == -(-t.lineitem.count() // 100) and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == forms.PRINTED_BYTES
    tune(spark)


def test_written_cells_are_those_of_the_grid_and_not_dealt_out_by_cell(spark):
    from paperflow.operators import layout as P
    from paperflow.plans import layout
    from paperflow.plans.registry import Tables

    lines, grids = layout.located(Tables(spark, "/root/testdata/sf0.001"))
    pieces = P.assign_cells(lines, grids)
    written, every = P.written_cells(pieces, grids), P.grid_cells(pieces, grids).where("text <> ''")
    columns = sorted(every.columns)
    assert sorted(written.columns) == columns
    assert sorted(map(str, written.select(columns).collect())) == sorted(map(str, every.select(columns).collect()))
    assert not re.search(r"hashpartitioning\([^)]*slot", written._jdf.queryExecution().executedPlan().toString())


def test_grouping_does_not_depend_on_order_or_partitions(spark):
    start = dt.datetime(2025, 1, 1)
    df = spark.range(3000).select(F.concat(F.lit("p"), F.col("id")).alias("page_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("sender_id"),
                                  F.timestamp_seconds(F.lit(start.timestamp()) + F.col("id") * 7919 % 20011).alias("received_at"))
    one = {tuple(r) for r in M.group_pages(df).select("page_id", "document_no").collect()}
    other = {tuple(r) for r in M.group_pages(df.orderBy(F.rand(7)).repartition(13), bucket_seconds=60).select("page_id", "document_no").collect()}
    assert one == other


def test_candidates_plan_has_no_product(spark):
    from paperflow.plans.linkage import documents, patients
    from paperflow.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = L.candidates(documents(t), patients(t))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells_plan_has_no_product(spark):
    plan = QUERIES["p7_assign_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prefix_sums_level_by_level(spark):
    rows = [(k * 977 - 40_000, k % 7) for k in range(300)] + [(1 << 40, 5), (-(1 << 40), 2), (None, 3)]
    got = {r.n: r.before for r in scale.prefix_sums(spark.createDataFrame(rows, "n long, t long"), "n", "t", "before").collect()}
    low = lambda n: float("-inf") if n is None else n
    assert got == {n: sum(t for m, t in rows if low(m) < low(n)) for n, _ in rows}


def test_ids_are_numbered_without_one_task_for_all_blocks(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000 * 50_021).alias("k"))
    got = L.assign_ids(df, "k", "DOC", 100, block_size=65_536)
    assert {r.k: r.new_id for r in got.collect()} == {r.k: f"DOC-{101 + i:06d}" for i, r in enumerate(df.orderBy("k").collect())}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(0," not in plan and "windowspecdefinition(_group3" in plan


def test_running_sums_and_maxima_before_each_row(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    got = scale.running_before(df, ["k"], ["id"], scale.block("id", 100), {"s": "v"}, {"m": "v"}).select("id", "s", "m")
    want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_radix_selection_of_a_hot_bin_and_of_odd_doubles(spark):
    # A million different values within one binade, in one key; the selection never sorts more than `small` of them.
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), (1 + F.col("id") * 7919 % n / (2 * n)).alias("v"))
    middle = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}
    got = scale.order_statistics(df, ["k"], "v", middle, 1000).first()
    assert (got.n, got.low, got.mid, got.high) == (n, 1.0, 1 + (n // 2) / (2 * n), 1 + (n - 1) / (2 * n))
    values = [float("nan"), float("inf"), -float("inf"), 0.0, -1e308, 1e308, 5e-324, -5e-324, 1.0, 1.0 + 2**-52, -3.5, 2.0, 2.0 - 2**-52, None]
    odd = spark.createDataFrame([("a", v) for v in values] * 3, "k string, v double")
    ranks = {f"r{i}": F.lit(i) for i in range(39)}
    row = scale.order_statistics(odd, ["k"], "v", ranks, 1).first()
    ordered = sorted([v for v in values if v is not None and v == v] * 3) + [float("nan")] * 3
    assert str([row[f"r{i}"] for i in range(39)]) == str(ordered)


def test_known_messages_are_not_broadcast(spark):
    from paperflow.plans import QUERIES

    for name in ("m2_classify_inbound", "m3_webhook_summary", "m13_dedup_messages"):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString(), name


def test_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from paperflow import session
    from paperflow.plans import QUERIES

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "lineitem.parquet").write_bytes(b"x" * 4000)
    monkeypatch.setattr(session, "PARTITION_INPUT", 100)
    session.tune(spark, str(tmp_path))
    assert spark.conf.get(name) == "40" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    monkeypatch.undo()
    rows = QUERIES["v7_pages_multiset_equal"](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
