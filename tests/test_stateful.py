"""Streams over several batches and models, on small tables."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemill.operators import training as tr
from tidemill.operators.core import recurrence, row_position
from tidemill.operators.models import downcast, monitoring_alerts, recommend_cleaning
from tidemill.streaming import stateful as st

T0 = dt.datetime(2024, 1, 1)


def batches(spark, folder, *parts, schema):
    """One file a batch, read in order of writing."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_ema_goes_on_across_batches(spark, tmp_path):
    rows = [(s, at(i), float(i * 37 % 11)) for i in range(60) for s in "ab"]
    stream = batches(spark, tmp_path, rows[:31], rows[31:80], rows[80:], schema="sym string, ts timestamp, x double")
    got = spark.read.parquet(st.stream_ema(stream, f"file://{tmp_path}", 5, "x")).orderBy("sym", "ts").toPandas()
    want = recurrence(row_position(spark.createDataFrame(rows, "sym string, ts timestamp, x double")), "x", "ema", 2 / 6).orderBy("sym", "ts").toPandas()
    assert len(got) == 120 and (got.ema - want.ema).abs().max() < 1e-12


def test_upsert_keeps_the_newest(spark, tmp_path):
    schema = "sym string, ts timestamp, loaded long, x double"
    stream = batches(spark, tmp_path, [("a", at(0), 1, 1.0), ("a", at(1), 1, 2.0), ("a", at(2000), 1, 5.0)], [("a", at(1), 2, 3.0), ("a", at(0), 0, 9.0), ("b", at(1), 2, 4.0)], schema=schema)
    got = spark.read.parquet(st.stream_upsert(stream, f"file://{tmp_path}"))
    assert sorted((r.sym, r.ts, r.x) for r in got.collect()) == [("a", at(0), 1.0), ("a", at(1), 3.0), ("a", at(2000), 5.0), ("b", at(1), 4.0)]


def test_late_rows_go_aside(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", at(0)), ("a", at(200))], [("a", at(139)), ("a", at(141)), ("a", at(300))], schema="sym string, ts timestamp")
    rows, late = st.stream_late_rows(stream, f"file://{tmp_path}")
    assert sorted(r.ts for r in spark.read.parquet(rows).collect()) == [at(0), at(141), at(200), at(300)]
    assert [r.ts for r in spark.read.parquet(late).collect()] == [at(139)]


def test_outcomes_join_predictions(spark, tmp_path):
    p = batches(spark, tmp_path / "p", [(1, at(0), 1), (2, at(1), 0)], [(3, at(9000), 1)], schema="id long, ts timestamp, prediction int")
    o = batches(spark, tmp_path / "o", [(1, at(10), 1)], [(9, at(9000), 1)], schema="id long, ts timestamp, actual int")
    out = f"file://{tmp_path}/out"
    st.stream_outcome_join(p, o).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(out).awaitTermination()
    got = {r.id: r.actual for r in spark.read.parquet(out).collect()}
    assert got[1] == 1 and 2 in got and got[2] is None


def test_late_rows_change_no_state(spark, tmp_path):
    first, second = [("a", at(i), float(i)) for i in range(10)], [("a", at(4), 99.0), ("a", at(10), 10.0), ("b", at(0), 5.0)]
    stream = batches(spark, tmp_path, first, second, [("a", at(11), 11.0), ("b", at(1), 6.0)], schema="sym string, ts timestamp, x double")
    got = {(r.sym, r.ts): r.ema for r in spark.read.parquet(st.stream_ema(stream, f"file://{tmp_path}", 5, "x")).where("x <> 99").collect()}
    want = recurrence(row_position(spark.createDataFrame([("a", at(i), float(i)) for i in range(12)] + [("b", at(i), 5.0 + i) for i in range(2)], "sym string, ts timestamp, x double")), "x", "ema", 2 / 6)
    assert all(abs(got[r.sym, r.ts] - r.ema) < 1e-12 for r in want.collect()) and len(got) == 14
    assert [r.ema for r in spark.read.parquet(f"file://{tmp_path}/rows").where("x = 99").collect()] == [None]


def test_wilder_means_of_a_stream(spark, tmp_path):
    rows = [("a", at(i), float(i * 37 % 11), float(i % 5)) for i in range(40)]
    stream = batches(spark, tmp_path, rows[:7], rows[7:], schema="sym string, ts timestamp, x double, z double")
    got = spark.read.parquet(st.stream_wilder(stream, f"file://{tmp_path}", 4, ["x", "z"])).orderBy("ts").toPandas()
    for c in "xz":
        assert (got[f"wilder_{c}"] - got[c].ewm(alpha=0.25, adjust=False).mean()).abs().max() < 1e-12


def test_monitoring_adds_up_over_batches(spark, tmp_path):
    good, bad = [(at(i), 1, 1) for i in range(8)], [(at(i), 1, 0) for i in range(20, 22)]
    stream = batches(spark, tmp_path, bad, [*good, (at(3000), 1, None)], [(at(1500), 0, 1)], schema="ts timestamp, prediction int, actual int")
    alerts = spark.read.parquet(st.stream_monitoring(stream, f"file://{tmp_path}")).collect()
    assert sorted((r.batch, r.subject, r.value) for r in alerts) == [(0, "2024-01-01", 0.0), (2, "2024-01-02", 0.0)]


def test_monitoring_compacts_its_sums(spark, tmp_path):
    parts = [[(at(1500 * (k % 2)), 1, int(k % 3 > 0))] * (k + 1) for k in range(6)]
    stream = batches(spark, tmp_path, *parts, schema="ts timestamp, prediction int, actual int")
    alerts = spark.read.parquet(st.stream_monitoring(stream, f"file://{tmp_path}", least=2.0, every=2))
    got = {r.batch: r.value for r in alerts.collect()}
    for k in range(6):
        seen = [row for j in range(k % 2, k + 1, 2) for row in parts[j]]
        assert abs(got[k] - sum(r[1] == r[2] for r in seen) / len(seen)) < 1e-12
    wholes = spark.read.parquet(f"file://{tmp_path}/wholes")
    assert {r.batch: r.n for r in wholes.groupBy("batch").agg(F.sum("known").alias("n")).collect()} == {1: 3, 3: 10, 5: 21}


def test_parabolic_sar_by_blocks(spark):
    from tidemill.operators.indicators import psar, sar_step

    rows = [(s, i, 100 + 10 * math.sin(i / 9 + k) + (i * 37 % 11) / 4) for k, s in enumerate("ab") for i in range(500)]
    bars = spark.createDataFrame([(s, i, x + 1, x - 1) for s, i, x in rows], "sym string, rn long, high double, low double")
    want, state = {}, None
    for s, i, x in rows:
        state = sar_step(None if i == 0 else state, x + 1, x - 1, 0.02, 0.2)
        want[s, i] = state[1] if state[0] else None
    for block, lead in ((64, 1), (1000, 50)):
        assert {(r.sym, r.rn): r.psar for r in psar(bars, block=block, lead=lead).collect()} == want


def test_flat_series_take_few_rounds(spark):
    from tidemill.operators.indicators import SAR_STATE, sar_states, sar_step

    # A peak that no later bar forgets: with a round for each block this would take 39.
    rows = [("a", i, 120.0 if i < 3 else 100.0, 99.0) for i in range(40 * 16)]
    states, rounds = sar_states(spark.createDataFrame(rows, "sym string, rn long, high double, low double"), block=16, lead=4)
    state = None
    want = {}
    for _, i, high, low in rows:
        state = sar_step(state, high, low, 0.02, 0.2)
        want[i // 16] = state
    got = {r.b: tuple(r[f"out_{c}"] for c in SAR_STATE) for r in states.collect()}
    assert rounds <= 7 and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_chi2_p_values(spark):
    from tidemill.operators.metrics import upper_gamma

    # Critical values of the chi-squared distribution: statistic, degrees of freedom, p.
    known = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (0.0, 4, 1.0), (43.772972, 30, 0.05), (500.0, 3, 0.0), (1.386294, 2, 0.5)]
    got = spark.createDataFrame(known, "x double, k int, p double").select("p", upper_gamma(F.col("k") / 2, F.col("x") / 2).alias("q")).collect()
    assert all(abs(r.p - r.q) < 1e-6 for r in got)


def test_p_values_of_many_categories(spark):
    from decimal import Decimal, getcontext

    from tidemill.operators.metrics import upper_gamma

    getcontext().prec = 40

    def exact(k, x):
        """Q(k / 2, x / 2) as finite sums; for odd k with erfc by its series."""
        y, e = Decimal(x) / 2, (-Decimal(x) / 2).exp()
        if k % 2 == 0:
            t = total = e
            for j in range(1, k // 2):
                t = t * y / j
                total += t
            return float(total)
        first = t = 2 * (y / Decimal("3.14159265358979323846264338327950288420")).sqrt() * e
        n, series, total = 0, Decimal(0), Decimal(0)
        while t > Decimal("1e-45") or n < 2 * y:
            series, n = series + t, n + 1
            t = t * y * 2 / (2 * n + 1)
        t = first
        for j in range(1, (k - 1) // 2 + 1):
            total += t
            t = t * y * 2 / (2 * j + 1)
        return float(1 - series + total)

    cases = [(1, 0.5), (1, 40.0), (2, 5.0), (3, 7.8), (3, 100.0), (5, 0.1), (19, 30.0), (20, 9.0), (101, 150.0), (1000, 930.0), (10_000, 10_302.0), (20_000, 20_302.0), (100_001, 100_400.0)]
    got = spark.createDataFrame(cases, "k int, x double").select("k", "x", upper_gamma(F.col("k") / 2, F.col("x") / 2).alias("q")).collect()
    for r in got:
        want = exact(r.k, r.x)
        assert abs(r.q - want) <= 1e-8 * want, (r.k, r.x, r.q, want)
    # A million: half of the distribution lies above its median, about k - 2 / 3.
    middle = spark.range(1).select(upper_gamma(F.lit(500_000.0), F.lit(500_000 - 1 / 3)).alias("q")).first().q
    assert abs(middle - 0.5) < 1e-8


def test_drift_report_reads_the_table_once(spark):
    from tidemill.operators.metrics import _histogram, drift_report

    rows = [(k % 2, float(k % 50), float(k % 7) + (k % 2), f"c{k % 3}", "ab"[k % 2], None) for k in range(600)]
    df = spark.createDataFrame(rows, "now int, same double, moved double, flat string, split string, none string")
    got = {r.column: (r.test, r.drift) for r in drift_report(df, "now", ["same", "moved", "flat", "split", "none"]).collect()}
    assert got == {"same": ("ks", False), "moved": ("ks", True), "flat": ("chi2", False), "split": ("chi2", True)}
    h = _histogram(df, "now", ["same", "flat"], {"same"})
    assert sorted((r.column, r.a + r.b) for r in h.groupBy("column").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()) == [("flat", 600), ("same", 600)]


def test_grouped_quantiles(spark):
    import numpy as np

    from tidemill.operators.core import grouped_quantiles

    rng = np.random.default_rng(3)
    heavy = {"a": np.exp(rng.normal(0, 6, 4000)), "b": np.repeat([1.0, 2.0, 5.0], [900, 1, 99]), None: np.array([4.0])}
    rows = [(g, float(x), float(-x) if k % 3 else None) for g, v in heavy.items() for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for accuracy in (2000, 10):  # a coarse sketch makes wide brackets
        got = {(r.g, r.column, r.share): r.value for r in grouped_quantiles(df, ["g"], ["x", "y"], [0.0, 0.25, 0.5, 0.99], accuracy).collect()}
        for g, v in heavy.items():
            for column, values in (("x", v), ("y", -v[np.arange(len(v)) % 3 > 0])):
                for p in (0.0, 0.25, 0.5, 0.99):
                    want = np.quantile(values, p) if len(values) else None
                    assert want is None and (g, column, p) not in got or abs(got[g, column, p] - want) <= 1e-9 * max(1, abs(want))


def test_models_save_load_and_score(spark, tmp_path):
    rows = spark.range(400).select(F.lit("a").alias("sym"), F.col("id").alias("rn"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z")).withColumn("target", (F.col("x") > 8).cast("int"))
    model = tr.train_random_forest(rows, ["x", "z"], trees=5)
    tr.save_model(model, f"file://{tmp_path}/m")
    models = tr.load_models({"m": f"file://{tmp_path}/m", "absent": f"file://{tmp_path}/none"})
    assert list(models) == ["m"]
    with_null = rows.withColumn("x", F.when(F.col("rn") > 0, F.col("x")))
    scored = tr.score_batch(models["m"], with_null)
    assert scored.count() == 399 and tr.quality(scored).first().accuracy > 0.95
    importance = {r.feature: r.importance for r in tr.permutation_importance(model, rows, ["x", "z"], 3).collect()}
    assert importance["x"] > 0.2 > abs(importance["z"])
    moved = tr.permuted(rows, "x", 1)
    assert moved.count() == 400 and moved.agg(F.sum("x")).first()[0] == rows.agg(F.sum("x")).first()[0]


def test_small_tables(spark):
    t = spark.createDataFrame([(1, 300, 0.5, 0.1, "q"), (None, -5, None, 0.2, None)], "a long, b int, c double, d double, e string")
    assert [k for _, k in downcast(t).dtypes] == ["tinyint", "smallint", "float", "double", "string"]
    assert [k for _, k in downcast(t.where("a > 9")).dtypes] == ["bigint", "int", "double", "double", "string"]
    tracked = spark.createDataFrame([(at(0), 0.5), (at(1500), 0.9), (at(3000), None)], "period timestamp, accuracy double")
    drift = spark.createDataFrame([("x", 0.01), ("y", 0.5)], "column string, p_value double")
    assert sorted(r.subject for r in monitoring_alerts(tracked, drift).collect()) == ["2024-01-01", "x"]
    counts = spark.createDataFrame([(1, 0, 2, 1)], "missing int, spikes int, zero_or_negative int, gaps int")
    assert recommend_cleaning(counts).count() == 3


def test_pipeline_stages_fit_save_and_load(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from tidemill.operators.stages import IndicatorStage, ScaleStage

    rows = [("a", at(i), 100.0 + i % 7, 101.0 + i % 5, 99.0 - i % 3, 5.0) for i in range(80)]
    bars = spark.createDataFrame(rows, "sym string, ts timestamp, close double, high double, low double, volume double")
    stages = [IndicatorStage(kind="macd"), IndicatorStage(kind="rsi_sma"), ScaleStage(columns=["macd", "rsi_sma"], kind="robust")]
    model = Pipeline(stages=stages).fit(bars)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    got = PipelineModel.load(f"file://{tmp_path}/m").transform(bars).orderBy("ts").toPandas()
    want = Pipeline(stages=stages[:2]).fit(bars).transform(bars).orderBy("ts").toPandas()
    low, mid, high = want.macd.quantile([0.25, 0.5, 0.75])
    assert (got.macd - (want.macd - mid) / (high - low)).abs().max() < 1e-9 and len(got) == 80


BARS = "sym string, ts timestamp, high double, low double, close double"


def wave(i, k):
    x = 100 + 10 * math.sin(i / 9 + k)
    return x + 1 + (i * 37 % 11) / 4, x - 1 + (i * 37 % 11) / 4, x + (i * 31 % 7) / 4


def test_streamed_indicators_go_on_after_restarts(spark, tmp_path):
    """Bars out of order within the delay, a restart between batches, a symbol that goes on from a batch result, late bars."""
    from tidemill.operators import indicators as ind
    from tidemill.streaming.live import Live, run_live, states_of

    live = Live(spans=(5, 20))
    rows = [(s, at(i), *wave(i, k)) for k, s in enumerate("abc") for i in range(90)]
    old = [r for r in rows if r[0] == "c" and r[1] < at(30)]
    initial = states_of(spark.createDataFrame(old, BARS), live)
    coming = [r for r in rows if not (r[0] == "c" and r[1] < at(30))]
    batch = lambda r: min((r[1] - T0).seconds // 1800, 2)
    swap = lambda r: (r[1] - T0).seconds // 60 % 30 >= 26 and batch(r) < 2 and (r[1] - T0).seconds // 60 % 2 == 0
    late = [("a", at(5), 500.0, 400.0, 450.0)]
    for k in range(3):
        part = [r for r in coming if batch(r) + swap(r) == k][::-1] + late * (k == 2)
        spark.createDataFrame(part, BARS).coalesce(2).write.parquet(f"{tmp_path}/in/{k}")
        query = run_live(spark.readStream.schema(BARS).parquet(f"{tmp_path}/in/*"), f"file://{tmp_path}", "10 minutes", live, initial)
    got = spark.read.parquet(f"{tmp_path}/rows").orderBy("sym", "ts").toPandas()
    b = row_position(spark.createDataFrame(rows, BARS))
    want = ind.emas(b, (5, 20)).join(ind.wilder_set(b).select("sym", "rn", "rsi_14", "atr_14"), ["sym", "rn"], "left").join(ind.psar(b).select("sym", "rn", "psar"), ["sym", "rn"])
    # The last bar is at minute 89, so the watermark ends at 79.
    want = want.where(F.col("ts") <= F.lit(at(79))).where("sym <> 'c' or rn >= 30").orderBy("sym", "ts").toPandas()
    assert len(got) == len(want) and (got.ts == want.ts).all() and (got.sym == want.sym).all()
    for c in ("ema_5", "ema_20", "rsi_14", "atr_14", "psar"):
        assert (got[c].isna() == want[c].isna()).all() and (got[c] - want[c]).abs().max() < 1e-9
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "now").load()
    assert state.count() == 3 and query.lastProgress["stateOperators"][0]["customMetrics"].get("rocksdbPutCount") is not None


def test_trees_as_tables_score_like_their_models(spark):
    from tidemill.operators.trees import NODES, node_table, score_nodes

    rows = [("a", i, float(i % 17), float(i * 7 % 5), int(i % 17 > 8) ^ int(i % 29 == 0), "val" if i % 4 == 0 else "train") for i in range(600)]
    df = spark.createDataFrame(rows, "sym string, rn long, x double, z double, target int, part string")
    for model, boosted in ((tr.train_random_forest(df, ["x", "z"], trees=4, depth=3), False), (tr.train_gbt(df, ["x", "z"], rounds=3), True)):
        nodes = node_table(model, ["x", "z"])
        assert {k for k, _ in nodes.dtypes} == {c.split(" ")[0] for c in NODES.split(", ")}
        held = df.withColumn("x", F.when(F.col("rn") > 2, F.col("x")))
        a = {r.rn: r.prob for r in tr.score_batch(model, held).collect()}
        b = {r.rn: r.prob for r in score_nodes(nodes, held, ["x", "z"], boosted).collect()}
        assert a.keys() == b.keys() and len(a) == 597 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
        assert score_nodes(nodes.limit(0), df, ["x", "z"]).count() == 0


def test_halving_promotes_the_best(spark):
    from tidemill.operators.search import draw_trials, fitted_trials, halving_winner, in_share, successive_halving

    space = {"kind": ["a", "b", "c"], "n": (3, 5), "rate": ("log", 0.01, 1.0), "x": (0.0, 2.0)}
    trials = draw_trials(spark, space, 200, 7)
    rows = trials.collect()
    assert rows[:50] == draw_trials(spark, space, 50, 7).collect() != draw_trials(spark, space, 50, 8).collect()
    assert {r.kind for r in rows} == {"a", "b", "c"} and {r.n for r in rows} == {3, 4, 5} and all(0.01 <= r.rate <= 1 and 0 <= r.x < 2 for r in rows)
    assert 60 < sum(r.rate < 0.1 for r in rows) < 140
    # Values that a share of the rows blurs; trial 5 has none, ties go to the lower trial.
    value = lambda x, share, trial: F.when(trial != 5, F.round(x + (1 - share) * (trial % 3), 1))
    rungs = successive_halving(trials.limit(20), lambda t, share: t.select("trial", value(F.col("x"), F.lit(share), F.col("trial")).alias("value")))
    got = [(r.rung, r.trial, r.promoted) for r in rungs.collect()]
    left, want = {r.trial: r.x for r in rows[:20]}, []
    for rung in range(3):
        share = 3.0 ** (rung - 2)
        scored = sorted(left, key=lambda t: (t == 5, -round(left[t] + (1 - share) * (t % 3), 1), t))
        best = scored[: max(1, len(scored) // 3)] if rung < 2 else []
        want += [(rung, t, t in best) for t in left]
        left = {t: left[t] for t in best}
    assert sorted(got) == sorted(want)
    assert halving_winner(rungs, trials).first().trial == min((t for r, t, _ in want if r == 2), key=lambda t: (-round({r.trial: r.x for r in rows}[t], 1), t))
    ids = spark.range(2000)
    small, large = ({r.id for r in ids.where(in_share(s, "id")).collect()} for s in (0.1, 0.4))
    assert small < large and 130 < len(small) < 270
    labelled = spark.createDataFrame([("a", i, float(i % 17), int(i % 17 > 8), ("train", "val")[i % 5 == 0]) for i in range(500)], "sym string, rn long, x double, target int, part string")
    few = spark.createDataFrame([(0, "forest", 4, 2), (1, "boosted", 2, 2)], "trial long, model string, trees int, depth int")
    assert all(r.value > 0.99 for r in fitted_trials(labelled, ["x"])(few, 0.5).collect())


def test_one_tree_of_bars_for_all_runs(spark):
    from tidemill.operators import backtest as bt

    rows = [("a", i, at(i), *wave(i, 0), 1.5, (i * 7919 % 100) / 100) for i in range(150)]
    bars = spark.createDataFrame(rows, "sym string, rn long, ts timestamp, high double, low double, close double, atr double, prob double")
    grid = spark.createDataFrame([(0, 1.0, 2.0, 0.6), (1, 1.0, 2.0, 0.9), (2, 2.0, 1.0, 0.6), (3, 1.0, 1.0, 9.0)], "run_id long, sl double, tp double, least double")
    got = {r.run_id: (r.trades, r.final_equity) for r in bt.strategy_search(bars, grid, 0.1, 1000.0, 0.02, 0.001).collect()}
    for run in grid.collect():
        one = bars.withColumn("signal", F.when(F.col("prob") > run.least, "Long").otherwise("Flat"))
        log = bt.trade_log(bt.nonoverlap_trades(bt.cut(bt.barrier_outcome(one, run.sl, run.tp, 0.1))), 1000.0, 0.02, 0.001).orderBy("trade_no").collect()
        assert got[run.run_id][0] == len(log) and abs(got[run.run_id][1] - (log[-1].equity if log else 1000.0)) < 1e-9


def test_text_columns_by_sketches(spark):
    from tidemill.operators import models as mo

    rows = [(at(i * 60), f"k{i % 20}", str(at(i)), f"n{i}", f"h{i // 2}", None) for i in range(4000)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, moment string, name string, half string, none string")
    columns = ["kind", "moment", "name", "half", "none"]
    days = mo.string_summaries(df, columns)
    assert days.count() == 5 * 167
    merged = {r["column"]: r for r in mo.string_kinds(days).collect()}
    for c, n in (("kind", 20), ("moment", 4000), ("name", 4000), ("half", 2000), ("none", 1)):
        assert abs(merged[c]["distinct"] - n) <= 4 * mo.SKETCH_ERROR * n + 0.5
    assert merged["half"].kind == "unsure"
    kinds = mo.narrow_strings(df, columns)
    got = {r["column"]: r.kind for r in kinds.collect()}
    assert got == {"kind": "category", "moment": "timestamp", "name": "string", "half": "string", "none": "category"}
    assert dict(mo.parse_times(df, kinds).dtypes) == {**dict(df.dtypes), "moment": "timestamp"}


def test_folds_from_sql(spark):
    import pytest

    from tidemill.operators.folds import register_folds

    register_folds(spark)
    spark.createDataFrame([("a", 10), ("b", 3)], "name string, n long").createOrReplaceTempView("sizes")
    rows = spark.sql("SELECT * FROM cv_folds(TABLE(sizes) PARTITION BY name, kind => 'expanding', start => 4, step => 3, test => 2)")
    assert rows.columns[0] == "name" and sorted(tuple(r) for r in rows.collect()) == [("a", 0, 0, 4, 4, 6), ("a", 1, 0, 7, 7, 9)]
    for wrong in ("kind => 'expanding', start => 4", "kind => 'other', start => 4", "kind => 'rolling', window => 0, step => 1, test => 1"):
        with pytest.raises(Exception, match="kind is one of|not right|over 0"):
            spark.sql(f"SELECT * FROM cv_folds(TABLE(sizes) PARTITION BY name, {wrong})").collect()
