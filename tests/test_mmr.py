import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parasift.operators.mmr import _select_numpy, mmr_select


def test_reference_four_vectors():
    # 4 x 3 matrix, similarities [1, 0, .9, 0], top 2, lambda .5 -> first pick is 0, two picks
    u = np.array([[1, 0, 0], [0, 1, 0], [0.9, 0.1, 0], [0, 0, 1]], dtype=float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    picks, _ = _select_numpy(u, np.array([1.0, 0.0, 0.9, 0.0]), 2, 0.5)
    assert picks[0] == 0 and len(picks) == 2


def test_ties_first_highest_then_lowest():
    u = np.eye(4)
    picks, _ = _select_numpy(u, np.array([0.5, 0.5, 0.5, 0.5]), 4, 0.65)
    assert picks == [3, 0, 1, 2]


def test_k_larger_than_group_and_single():
    u = np.eye(3)
    picks, _ = _select_numpy(u, np.array([0.1, 0.2, 0.3]), 10, 0.65)
    assert sorted(picks) == [0, 1, 2]
    picks, _ = _select_numpy(np.eye(1), np.array([0.0]), 5, 0.65)
    assert picks == [0]


def _rand_unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 25), st.integers(1, 8), st.integers(0, 10_000), st.floats(0.0, 1.0))
def test_properties_no_duplicates_and_prefix(n, k, seed, lam):
    rng = np.random.default_rng(seed)
    u = _rand_unit(rng, n, 5)
    rep = rng.uniform(-1, 1, size=n)
    p_k, _ = _select_numpy(u, rep, k, lam)
    p_k1, _ = _select_numpy(u, rep, k + 1, lam)
    assert len(p_k) == min(k, n) and len(set(p_k)) == len(p_k)
    assert p_k1[: len(p_k)] == p_k  # larger N only extends the set


def test_grouped_and_lockstep_paths_agree(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in [(0, 40), (1, 3), (2, 25)]:
        u = _rand_unit(rng, n, 6)
        rep = rng.uniform(-1, 1, size=n)
        for i in range(n):
            rows.append((g, i, u[i].tolist(), float(rep[i])))
    df = spark.createDataFrame(rows, "g int, pos long, u array<double>, rep double")
    a = mmr_select(df, "g", "pos", "u", "rep", k=6, lam=0.65)
    b = mmr_select(df, "g", "pos", "u", "rep", k=6, lam=0.65, max_group_rows=10)  # groups 0 and 2 lock-step
    ka = sorted((r.g, r.rank, r.pos) for r in a.collect())
    kb = sorted((r.g, r.rank, r.pos) for r in b.collect())
    assert ka == kb and len(ka) == 6 + 3 + 6


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.65, 1.0])
def test_lazy_rounds_give_the_greedy_picks_with_any_list_length(spark, monkeypatch, lam):
    """Near copies and exact ties, lists from one candidate to all rows."""
    from parasift.operators import mmr

    rng = np.random.default_rng(3)
    u = np.repeat(_rand_unit(rng, 12, 4), 5, axis=0)
    u[::7] = _rand_unit(rng, len(u[::7]), 4)
    rep = np.round(u @ u.mean(axis=0), 3)  # ties among copies
    want = _select_numpy(u, rep, 7, lam)[0]
    df = spark.createDataFrame([(1, i, u[i].tolist(), float(rep[i])) for i in range(len(u))] + [(2, 0, [1.0, 0.0, 0.0, 0.0], 0.5), (2, 1, None, 0.9)],
                               "g int, pos long, u array<double>, rep double").repartition(5)
    spec = mmr.MMRSpec(("g",), "pos", "u", "rep", 7, lam)
    for limit in (1, 3, 20, 1000):
        got = sorted((r["g"], r["rank"], r["pos"]) for r in mmr._lazy_path(df, spec, 2, candidates=limit).collect())
        assert got == [(1, n + 1, p) for n, p in enumerate(want)] + [(2, 1, 0)], limit


def test_rounds_write_no_vectors_and_few_of_them(spark, monkeypatch):
    from parasift.operators import mmr

    rng = np.random.default_rng(5)
    u = _rand_unit(rng, 400, 8)
    rep = u @ _rand_unit(rng, 1, 8)[0]
    df = spark.createDataFrame([(1, i, u[i].tolist(), float(rep[i])) for i in range(len(u))], "g int, pos long, u array<double>, rep double")
    written = []
    keep = mmr.write_scratch

    def note(rows, name):
        written.append((name, rows.columns))
        return keep(rows, name)

    monkeypatch.setattr(mmr, "write_scratch", note)
    out = mmr._lazy_path(df, mmr.MMRSpec(("g",), "pos", "u", "rep", 5, 0.65), 1)
    assert [r["pos"] for r in out.orderBy("rank").collect()] == _select_numpy(u, rep, 5, 0.65)[0]
    assert [c for n, c in written if n == "mmr-picks"] and len([n for n, _ in written if n == "mmr-picks"]) <= 2
    assert all("_u" not in c for n, c in written if n != "mmr-base")
