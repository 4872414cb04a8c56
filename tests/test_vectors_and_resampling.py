"""Vector table, grid search, exact quantiles, prominent peaks and Monte-Carlo tests against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import mlprep, resampling as mc, retrieval as rag, vectors
from barlab.operators.volatility import local_maxima, separated_peaks
from helpers import bars, frame, series


def nearest_by_hand(store, queries, k):
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    out = set()
    for q, x in queries:
        scores = sorted((-round(2 * float(unit(x) @ unit(v)) - 1, 12), i) for i, v in store)
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(scores[:k])}
    return out


def clustered(rng, n, d=8):
    centres = rng.standard_normal((6, d))
    return [(i, centres[i % 6] + 0.2 * rng.standard_normal(d)) for i in range(n)]


def vector_frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} bigint, embedding array<double>")


@pytest.mark.parametrize("rows,group_bytes", [(4096, 64_000_000), (16, 3000)])
def test_grid_search_is_exact(spark, rows, group_bytes):
    rng = np.random.default_rng(1)
    store = clustered(rng, 240)
    store += [(500 + i, store[i][1]) for i in range(10)]  # equal vectors: the smaller id first
    asked = [(1000 + i, v + 0.05 * rng.standard_normal(8)) for i, v in store[:60]] + [(2000, store[0][1])]
    blocks = vectors.blocks_of(vector_frame(spark, [*store, (900, None)]), rows)
    got = vectors.grid_search(blocks, vector_frame(spark, asked, "query_id"), 4, group_bytes=group_bytes).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == nearest_by_hand(store, asked, 4)
    assert vectors.grid_search(blocks, vector_frame(spark, [], "query_id"), 4).count() == 0
    assert vectors.grid_search(vectors.blocks_of(vector_frame(spark, [])), vector_frame(spark, asked, "query_id"), 4).count() == 0


def test_many_queries_leave_the_broadcast_way(spark, monkeypatch):
    rng = np.random.default_rng(3)
    store, asked = clustered(rng, 90), [(i, v) for i, v in clustered(rng, 12)]
    want = nearest_by_hand(store, asked, 3)
    for most in (100, 5):
        monkeypatch.setattr(rag, "QUERY_SLICE", most)
        got = rag.nearest(vector_frame(spark, store), vector_frame(spark, asked, "query_id"), 3).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want
    assert rag.nearest(vector_frame(spark, store), vector_frame(spark, [], "query_id"), 3).count() == 0


def test_blocks_are_skipped_only_where_nothing_better_can_be():
    rng = np.random.default_rng(4)
    x = [v / np.linalg.norm(v) for _, v in clustered(rng, 300)]
    blocks = []
    for c in range(6):
        ids = np.arange(c, 300, 6)
        m = np.stack([x[i] for i in ids])
        blocks.append((ids, m, m.mean(axis=0), float(np.sqrt(((m - m.mean(axis=0)) ** 2).sum(axis=1).max())), np.array([0])))
    seen = []

    class Counted(vectors.Best):
        def offer(self, at, score, ids):
            seen.append(score.size)
            super().offer(at, score, ids)

    q = np.stack(x[:40])
    original, vectors.Best = vectors.Best, Counted
    try:
        best = vectors.best_in_blocks(q, blocks, 3)
    finally:
        vectors.Best = original
    store = [(i, x[i]) for i in range(6, 300)]  # the first place of each block is hidden
    got = {(int(a), int(b)) for a, b in zip(best.query, best.id)}
    assert got == {(a, b) for a, b, _ in nearest_by_hand(store, list(enumerate(q)), 3)}
    assert sum(seen) < 0.7 * 40 * 294


def test_vector_table_replaces_retries_and_compacts(spark, tmp_path):
    rng = np.random.default_rng(5)
    first, second = clustered(rng, 60), [(i, rng.standard_normal(8)) for i in range(40, 75)]
    rows = lambda batch, part: vector_frame(spark, part).withColumns({"content": F.format_string(f"{batch}:%d", "vec_id"), "metadata": F.lit("{}")})
    table = vectors.VectorTable(spark, f"{tmp_path}/store")
    asked = vector_frame(spark, [(i, v) for i, v in first[::7]], "query_id")
    assert table.rows().count() == 0 and table.search(asked).count() == 0
    table.write(1, rows(1, first).unionByName(rows(1, first[:5])), 16)
    table.write(2, rows(2, second), 16)
    table.write(2, rows(9, second), 16)  # complete already
    now = dict(first) | dict(second)
    want = nearest_by_hand(sorted(now.items()), first[::7], 3)
    for t in (table, table.compact(3, rows_per_block=32)):
        assert {r.vec_id: r.content for r in t.rows().collect()} == {i: f"{2 if i >= 40 else 1}:{i}" for i in now}
        got = t.search(asked, 3).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want and all(r.content.endswith(f":{r.vec_id}") for r in got)
    newest = table.compact(4, keep_from=2)
    assert {r.vec_id for r in newest.rows().collect()} == set(dict(second))


def test_batch_that_broke_off_hides_nothing_until_it_is_retried(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = vector_frame(spark, clustered(rng, 20)).withColumns({"content": F.lit("x"), "metadata": F.lit("{}")})
    table = vectors.VectorTable(spark, f"{tmp_path}/store")
    table.write(1, rows)
    with monkeypatch.context() as m:
        m.setattr(vectors, "blocks_of", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.write(2, rows.where("vec_id < 3"))
    assert {r.batch for r in table.rows().collect()} == {1} and table.rows().count() == 20
    table.write(2, rows.where("vec_id < 3"))
    assert sorted((r.vec_id, r.batch) for r in table.rows().collect()) == [(i, 2 if i < 3 else 1) for i in range(20)]


@pytest.mark.parametrize("small", [100_000, 5])
def test_exact_quantiles(spark, small):
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(997)], "b": [float(rng.randint(0, 3)) for _ in range(500)], "c": [7.0], "heavy": [rng.paretovariate(0.3) for _ in range(400)], None: [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("b", float("nan")), ("c", float("inf")), ("none", None)]
    got = {(r.g, r.q): r.quantile for r in mlprep.exact_quantiles(spark.createDataFrame(rows, "g string, value double").repartition(5), ["g"], (0.0, 0.25, 0.5, 0.75, 1.0), bins=16, small=small).collect()}
    assert got.keys() == {(g, q) for g in groups for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    for (g, q), x in got.items():
        assert x == pytest.approx(float(np.quantile(groups[g], q)), rel=1e-12, abs=1e-12)


def peaks_by_hand(x, distance, prominence):
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    kept, open_ = [], set(tops)
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if p in open_:
            kept.append(p)
            open_ -= {t for t in tops if abs(t - p) < distance}
    out = []
    for p in sorted(kept):
        valleys = []
        for way in (range(p, -1, -1), range(p, len(x))):
            low = x[p]
            for k in way:
                if x[k] > x[p]:
                    break
                low = min(low, x[k])
            valleys.append(low)
        if x[p] - max(valleys) >= prominence:
            out.append(p)
    return tops, out


def test_prominent_peaks_over_long_stretches(spark):
    rng = random.Random(8)
    x = [100.0 + (i // 40) % 3 + rng.choice([0, 0, 0.25, 0.5, 1.0]) for i in range(700)]
    x[300:330] = [130.0] * 30  # a flat top higher than all
    rows = [(*r[:4], v, v, v, *r[7:]) for r, v in zip(series(700, 3), x)]
    df = bars(spark, rows)
    for distance, prominence in ((5, 0.001), (3, 1.1), (2, 25.0)):
        tops, want = peaks_by_hand(x, distance, prominence)
        assert list(frame(separated_peaks(df, "high", distance, prominence, rounds=2), "bar_idx")["bar_idx"]) == want
    assert list(frame(local_maxima(df, "high"), "bar_idx")["bar_idx"]) == tops


@pytest.mark.parametrize("block", [4096, 16])
def test_monte_carlo_replicates_match_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(mc, "BLOCK", block)
    monkeypatch.setattr(mc, "CHUNK", 7)
    rng = random.Random(9)
    pnl = {s: [round(rng.uniform(-5, 6), 2) for _ in range(n)] for s, n in (("one", 1), ("some", 50), ("more", 83))}
    idx = mc.indexed_trades(spark.createDataFrame([(s, i, x) for s, xs in pnl.items() for i, x in enumerate(xs)], "strategy_id string, trade_no bigint, pnl double"))

    def path(values):
        top = equity = fall = 0.0
        for v in values:
            equity += v
            top = max(top, equity)
            fall = max(fall, top - equity)
        return fall, equity

    import hashlib
    for test, fn in (("perm", mc.permutation), ("boot", mc.bootstrap), ("noise", mc.noise)):
        got = {(r.strategy_id, r.rep): (r.max_drawdown, r.final_equity) for r in fn(idx, 20).collect()}
        assert got.keys() == {(s, r) for s in pnl for r in range(20)}
        for s, xs in pnl.items():
            key = int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
            u = mc.draws(mc.salt_of(42, test), key, np.arange(20), np.arange(len(xs)))
            for r in range(20):
                h = [int(v) for v in u[r]]
                values = {"perm": lambda: [xs[i] for i in sorted(range(len(xs)), key=lambda i: (h[i], i))], "boot": lambda: [xs[v % len(xs)] for v in h],
                          "noise": lambda: [x * (1 + (2 * v / 2**32 - 1) * 0.1) for x, v in zip(xs, h)]}[test]()
                assert got[s, r] == pytest.approx(path(values))


def test_big_strategies_are_streamed_in_parts(spark, monkeypatch):
    for name, value in {"BIG": 40, "UNIT": 60, "PART": 30, "SHARED": 60}.items():
        monkeypatch.setattr(mc, name, value)
    test_monte_carlo_replicates_match_plain_python(spark, monkeypatch, 16)


def test_parts_beyond_what_a_unit_holds(spark, monkeypatch):
    for name, value in {"BIG": 40, "HELD": 60, "UNIT": 60, "PART": 30, "SHARED": 60}.items():
        monkeypatch.setattr(mc, name, value)
    test_monte_carlo_replicates_match_plain_python(spark, monkeypatch, 16)


def test_lanes_follow_the_curve(monkeypatch):
    rng = np.random.default_rng(5)
    for steps, n in ((4, 1), (4, 3), (4, 4), (4, 50), (32, 31), (32, 5000)):
        monkeypatch.setattr(mc, "STEPS", steps)
        x = rng.normal(0, 3, n)
        assert mc.curve(mc.laned(x)) == pytest.approx([v[0] for v in mc.summary(x[None])])
    x = rng.integers(0, 2**32, 1000, np.uint32)
    assert (mc.unmix(mc.mix(x.copy())) == x).all()


@pytest.mark.parametrize("test", [mc.permutation, mc.bootstrap])
def test_units_read_the_trades_a_fixed_number_of_times(spark, monkeypatch, test):
    """The units of a strategy, each of which reads all of its trades, must not grow in number with the trades."""
    monkeypatch.setattr(mc, "BIG", 40)
    monkeypatch.setattr(mc, "UNIT", 60)
    units = []
    for n in (100, 800):
        idx = mc.indexed_trades(spark.createDataFrame([("some", i, float(i % 7) - 3) for i in range(n)], "strategy_id string, trade_no bigint, pnl double"))
        plan = test(idx, 100)._jdf.queryExecution().optimizedPlan().toString()
        units.append([int(x) for x in re.findall(r"Range \(0, (\d+)", plan)])
    assert units == [[4], [4]]


def test_no_replicate_is_shuffled(spark, monkeypatch):
    """Values of replicates must not meet an exchange: only sums of blocks and parts may."""
    idx = mc.indexed_trades(spark.createDataFrame([("some", i, float(i % 7) - 3) for i in range(300)], "strategy_id string, trade_no bigint, pnl double"))
    for big in (1 << 15, 40):
        monkeypatch.setattr(mc, "BIG", big)
        for test in (mc.permutation, mc.bootstrap, mc.noise):
            plan = test(idx, 20)._jdf.queryExecution().optimizedPlan().toString()
            assert "value" not in plan and "place" not in plan and "chunk" not in plan
