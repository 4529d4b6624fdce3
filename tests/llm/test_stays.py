import itertools
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from statewise.llm import stays as st

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import the tests

SCHEMA = "traj_id long, frame long, state int, loaded_at string, blk int, n_frames int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)


def brute(times, reach, penalty):
    """Least cost over all segmentations."""
    best = None
    for bits in itertools.product([0, 1], repeat=len(times) - 1):
        starts = [0, *[k + 1 for k, b in enumerate(bits) if b]]
        cost = penalty * len(starts) + sum(max(0, times[k] - times[k - 1] - reach) for k in range(1, len(times)) if k not in starts)
        if best is None or (cost, len(starts)) < best[:2]:
            best = (cost, len(starts), starts)
    return best


@pytest.mark.parametrize("reach,penalty", [(2, 0.5), (1, 3.0), (0, 2.5), (3, 10.0)])
def test_segmentation_is_optimal(reach, penalty):
    rng = np.random.default_rng(int(10 * penalty))
    for _ in range(30):
        times = np.cumsum(rng.integers(1, 7, 9)).tolist()
        starts = st.segment(times, reach, penalty)
        cost = penalty * len(starts) + sum(max(0, times[k] - times[k - 1] - reach) for k in range(1, 9) if k not in starts)
        assert cost == pytest.approx(brute(times, reach, penalty)[0]) and starts[0] == 0 and starts == sorted(set(starts))
    assert st.segment([]) == [] and st.segment([4]) == [0]


def expected(rows, least):
    held = {}
    for t, f, s, at in rows:
        if t is not None and f is not None and (t, f) in held:
            held[t, f] = max(held[t, f], (at or "", -10**9 if s is None else s))
        elif t is not None and f is not None:
            held[t, f] = (at or "", -10**9 if s is None else s)
    by = {}
    for (t, f), (_, s) in sorted(held.items()):
        if s >= 0:
            by.setdefault((t, s), []).append(f)
    out = set()
    for (t, s), frames in by.items():
        run = [frames[0]]
        for f in [*frames[1:], None]:
            if f is None or f - run[-1] > 2:
                if len(run) >= least:
                    out.add((t, s, run[0], run[-1], len(run), run[-1] - run[0] + 1))
                run = []
            run.append(f)
    return out


@pytest.mark.parametrize("penalty", [2.0, 5.0])
def test_blocks_do_not_change_stays(spark, penalty):
    rng = np.random.default_rng(int(penalty * 10))
    rows = [(1, int(f), int(rng.integers(0, 2)), "a") for f in np.cumsum(rng.integers(1, 8, 300))]
    df = table(spark, rows).cache()
    whole = sorted(map(tuple, st.stays(df, penalty=penalty, block=100_000).collect()))
    want = []
    for state in (0, 1):
        times = [f for _, f, s, _ in rows if s == state]
        cuts = [*st.segment(times, 2, penalty), len(times)]
        want += [(1, state, times[a], times[z - 1], z - a, times[z - 1] - times[a] + 1) for a, z in itertools.pairwise(cuts)]
    assert whole == sorted(want)
    for block in (4, 50):
        assert sorted(map(tuple, st.stays(df, penalty=penalty, block=block).collect())) == whole


def run_cost(times, events, labels, starts, penalty, reach, between):
    cost = sum(float(between(np.array(e), np.array(k))) for e, k in zip(events, labels, strict=True)) + penalty * sum(starts)
    return cost + sum(max(0, times[k] - times[k - 1] - reach) for k in range(1, len(times)) if not starts[k])


def scaled(i, j):
    return np.minimum(np.abs(i - j), 3) * 0.75


@pytest.mark.parametrize(("penalty", "between"), [(0.4, st.unlike), (1.5, st.unlike), (2.0, scaled), (4.0, scaled)])
def test_labels_are_optimal(penalty, between):
    rng = np.random.default_rng(int(penalty * 7))
    for _ in range(6):
        times = np.cumsum(rng.integers(1, 5, 6))
        events = rng.integers(0, 3, 6)
        label, starts = st.label_events(times, events, penalty, 2, between)
        assert starts[0] and all(starts[k] or label[k] == label[k - 1] for k in range(6))
        best = min(
            run_cost(times, events, labels, [True, *[a != b or cut for (a, b), cut in zip(itertools.pairwise(labels), cuts, strict=True)]], penalty, 2, between)
            for labels in itertools.product(sorted(set(events.tolist())), repeat=6) for cuts in itertools.product([False, True], repeat=5)
            if all(a == b or not cut for (a, b), cut in zip(itertools.pairwise(labels), cuts, strict=True))
        )
        assert run_cost(times, events, label, starts, penalty, 2, between) == pytest.approx(best)


@pytest.mark.parametrize(("penalty", "between", "least"), [(0.5, st.unlike, 1.0), (2.0, st.unlike, 1.0), (1.5, scaled, 0.75)])
def test_blocks_do_not_change_runs(spark, penalty, between, least):
    rng = np.random.default_rng(3)
    rows = []
    for t in (1, 2):
        state = 0
        for f in np.cumsum(rng.choice([1, 1, 1, 1, 1, 2, 6], 260)).tolist():
            if rng.random() < 0.12:
                state = int(rng.integers(0, 4))
            rows.append((t, f, int(rng.integers(0, 4)) if rng.random() < 0.12 else state, "a"))
    rows += [(3, 0, 1, "a"), (3, 1, None, "a"), (None, 1, 1, "a")]
    df = table(spark, rows).cache()
    cost = {}
    for block in (8, 100_000):
        got = st.near_runs(df, penalty, 2, between, least, block).collect()
        total = 0.0
        for t in (1, 2, 3):
            mine = sorted((r for r in got if r.traj_id == t), key=lambda r: r.first_frame)
            events = [(f, s) for k, f, s, _ in rows if k == t and s is not None]
            labels, starts = [], []
            for r in mine:
                inside = [s for f, s in events if r.first_frame <= f <= r.last_frame]
                assert r.n_frames == len(inside) and r.n_unlike == sum(s != r.state for s in inside) and r.duration == r.last_frame - r.first_frame + 1
                labels += [r.state] * len(inside)
                starts += [True] + [False] * (len(inside) - 1)
            assert len(labels) == len(events)
            total += run_cost([f for f, _ in events], [s for _, s in events], labels, starts, penalty, 2, between)
        cost[block] = total
    assert len({round(c, 9) for c in cost.values()}) == 1


@pytest.mark.parametrize("block", [4, 7, 4096])
@pytest.mark.parametrize("least", [1, 6])
def test_stays_equal_brute_force(spark, block, least):
    rng = np.random.default_rng(block)
    rows = []
    for t in (1, 2, 3):
        state = 0
        for f in range(120):
            if rng.random() < 0.1:
                state = int(rng.integers(0, 3))
            if rng.random() < 0.07:
                continue
            s = [None, -1, state][min(2, int(rng.integers(0, 12)))]
            rows.append((t, f, s, "2024-01-01"))
            if rng.random() < 0.1:
                rows.append((t, f, int(rng.integers(0, 3)), "2024-01-02"))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 3, 1, "x"), (4, None, 1, "x"), (5, 0, 2, None)]
    got = {tuple(r) for r in st.stays(table(spark, rows), least, block=block).collect()}
    assert got == expected(rows, least)


def test_empty(spark):
    assert st.stays(table(spark, [])).count() == 0 and st.near_runs(table(spark, [])).count() == 0
    assert st.found(table(spark, [(1, 1, None, "a"), (1, 2, -1, "a")])).count() == 0
