"""The kernel against a plain restatement that refits from scratch, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contextloom.plans.kernel import IncrementalModel, Kernel, Model, Params, alternate, component_count


def pca(rows, p_var):
    x = np.array(rows)
    mu = x.mean(0)
    cov = np.cov(x.T).reshape(x.shape[1], -1) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    v, c = np.linalg.eigh(cov)
    v, c = np.maximum(v[::-1], 0), c[:, ::-1]
    k = len(v) if p_var == 1 or v.sum() == 0 else next(i + 1 for i in range(len(v)) if v[: i + 1].sum() / v.sum() >= p_var or i + 1 == len(v))
    return mu, c[:, :k] * np.sqrt(v[:k])


def dist(x, m):
    y = (x - m[0]) @ m[1]
    return np.sqrt(y @ y)


def plain_v1(x, p):
    """Labels by position, by the rules, refitting each time from the stored rows."""
    first = p.first_rows
    mem, label = [list(range(first))], [1] * first
    models, cur, buf = [pca(x[:first], p.p_var)], 0, []
    for t in range(first, len(x)):
        s = [dist(x[t], m) for m in models]
        best = int(np.argmin(s))
        if s[best] > p.drift_threshold:
            buf.append(t)
            if len(buf) == p.drift_size:
                mem.append(buf)
                models.append(pca(x[buf], p.p_var))
                cur, buf = len(models) - 1, []
                label += [cur + 1] * p.drift_size
            continue
        if buf:
            label += [(best if p.partial_label_to == "best" else cur) + 1] * len(buf)
            if p.partial_memory_to == "current":
                mem[cur] = (mem[cur] + buf)[-p.model_mem :]
                models[cur] = pca(x[mem[cur]], p.p_var)
                buf = []
        mem[best] = (mem[best] + buf + [t])[-p.model_mem :]
        models[best] = pca(x[mem[best]], p.p_var)
        label.append(best + 1)
        cur, buf = best, []
    return label + [cur + 1] * len(buf), len(models)


def plain_v2(x, p):
    n = p.drift_size
    mem, models, cur, label, b = [list(range(n))], [pca(x[:n], p.p_var)], 0, [1] * n, []
    for t in range(n, len(x)):
        s = dist(x[t], models[cur])
        if s > p.drift_threshold:
            every = [dist(x[t], m) for m in models]
            cur = int(np.argmin(every))
            s = every[cur]
        b.append((t, s, cur))
        if len(b) > n:
            i, _, m = b.pop(0)
            mem[m] = (mem[m] + [i])[-p.model_mem :]
            models[m] = pca(x[mem[m]], p.p_var)
            label.append(m + 1)
        out = [s > p.drift_threshold for _, s, _ in b]
        if len(b) == n and out[0] and out[-1] and sum(out) > n / 2:
            mem.append([i for i, _, _ in b])
            models.append(pca(x[mem[-1]], p.p_var))
            cur, b = len(models) - 1, []
            label += [cur + 1] * n
    return label + [m + 1 for _, _, m in b], len(models)


def run(x, p):
    k, out = Kernel(p), []
    for t, r in enumerate(x):
        out += k.step(t, r)
    out += k.close()
    return k, out


def spells(seed, n=3, parts=((0, 30), (6, 25), (0, 20), (-5, 30), (6, 3), (0, 15))):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(m, 1, (k, n)) for m, k in parts])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("changes", [{}, {"partial_memory_to": "current"}, {"partial_label_to": "best"}, {"init_size": 14}, {"p_var": 1.0}, {"p_var": 0.6}])
def test_v1_labels_equal_the_plain_restatement(seed, changes):
    x = spells(seed)
    p = Params(**{"drift_threshold": 4.0, "drift_size": 8, "model_mem": 20} | changes)
    k, out = run(x, p)
    want, n = plain_v1(x, p)
    assert [c for _, c, _, _ in sorted(out)] == want
    assert len(k.models) == n > 1


@pytest.mark.parametrize("seed", range(4))
def test_v2_labels_equal_the_plain_restatement(seed):
    x = spells(seed)
    p = Params(drift_threshold=4.0, drift_size=8, model_mem=20, algorithm="v2")
    k, out = run(x, p)
    want, n = plain_v2(x, p)
    assert [c for _, c, _, _ in sorted(out)] == want
    assert len(k.models) == n > 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.sampled_from([None, 2, 3]), st.sampled_from(["v1", "v2"]), st.sampled_from(["batch_pca", "incremental"]), st.sampled_from(["interleave", "alternate"]), st.sampled_from(["best", "current"]))
def test_every_row_has_one_label_and_transitions_count_them(seed, m, limit, algorithm, backend, merge, to):
    r = np.random.default_rng(seed)
    x = r.normal(r.choice([0, 8, -8], m)[:, None], 1, (m, 2))
    p = Params(drift_threshold=3.0, drift_size=4, model_mem=10, model_limit=limit, algorithm=algorithm, model_backend=backend, merge=merge, partial_label_to=to)
    k, out = run(x, p)
    assert sorted(s for s, *_ in out) == list(range(m))
    assert sum(k.transitions.values()) == m
    assert limit is None or len(k.models) <= limit
    assert all(len(v.rows()) <= p.model_mem for v in k.models.values())
    if limit is None:
        c = [v for _, v, _, _ in sorted(out)]
        pairs = {}
        for a, b in zip([c[0], *c[:-1]], c, strict=True):
            pairs[a, b] = pairs.get((a, b), 0) + 1
        assert {e: n for e, n in k.transitions.items() if n} == pairs


def test_threshold_is_inclusive_and_ties_go_to_the_least_id():
    p = Params(drift_threshold=0.0, drift_size=2, model_mem=5)
    k, out = run(np.zeros((6, 2)), p)  # a model without variance scores everything 0 and never drifts
    assert [c for _, c, _, _ in out] == [1] * 6 and len(k.models) == 1
    k.models[2] = Model(2, [(0, np.zeros(2)), (1, np.zeros(2))], 9, p)
    assert k._scores(np.ones(2)) == (1, 0.0)


def test_short_streams_and_one_feature():
    p = Params(drift_threshold=1.0, drift_size=5, model_mem=5)
    for m in (0, 1, 4, 5):
        k, out = run(np.arange(m * 1.0).reshape(-1, 1), p)
        assert len(out) == m and len(k.models) == (m > 0)


def test_end_buffer_can_be_a_model():
    x = np.concatenate([spells(1, parts=((0, 20),)), spells(2, parts=((9, 3),))])
    a, _ = run(x, Params(drift_threshold=5.0, drift_size=8, model_mem=20, end_buffer="model"))
    b, _ = run(x, Params(drift_threshold=5.0, drift_size=8, model_mem=20))
    assert len(a.models) == len(b.models) + 1


def test_running_sums_equal_a_refit():
    r = np.random.default_rng(0)
    p = Params(drift_threshold=1, drift_size=5, model_mem=30, p_var=0.9)
    m = Model(1, [(i, v) for i, v in enumerate(r.normal(1e3, 1, (5, 4)))], 0, p)
    for i in range(700):
        m.absorb([(10 + i, r.normal(1e3, 1, 4))], i)
    mu, a = pca([v for _, v in m.rows()], 0.9)
    assert np.allclose(m.centroid, mu) and np.allclose(m.coeff @ m.coeff.T, a @ a.T, atol=1e-6)


def test_incremental_update_equals_batch_at_full_rank():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 5)) @ r.normal(size=(5, 5)) + 3
    p = Params(drift_threshold=1, drift_size=5, p_var=1.0)
    m = IncrementalModel(1, list(enumerate(x[:10])), 0, p)
    m.absorb(list(enumerate(x[10:50])), 1)
    other = IncrementalModel(2, list(enumerate(x[50:])), 0, p)
    m.join(other)
    cov = np.cov(x.T)
    assert np.allclose(m.coeff @ m.coeff.T, cov, atol=1e-8) and np.allclose(m.centroid, x.mean(0))


def test_component_count_and_alternation():
    assert component_count(np.array([3.0, 1.0]), 0.75) == 1
    assert component_count(np.array([3.0, 1.0]), 0.76) == 2
    assert component_count(np.array([0.0, 0.0]), 0.5) == 2
    assert alternate([1, 2, 3], [7, 8]) == [3, 8, 2]
    assert alternate([1, 2], [7, 8, 9], 5) == [2, 9, 1, 8, 7]


def test_score_is_the_root_of_the_quadratic_form():
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))
    m = Model(1, list(enumerate(x)), 0, Params(drift_threshold=1, drift_size=5, p_var=1.0))
    d = r.normal(size=3)
    assert np.isclose(m.score(d) ** 2, (d - x.mean(0)) @ np.cov(x.T) @ (d - x.mean(0)))
    m = Model(1, list(enumerate(x)), 0, Params(drift_threshold=1, drift_size=5, p_var=1.0, score="mahalanobis"))
    assert np.isclose(m.score(d) ** 2, (d - x.mean(0)) @ np.linalg.inv(np.cov(x.T)) @ (d - x.mean(0)))


def test_params_are_checked():
    for bad in ({"algorithm": "v3"}, {"p_var": 0}, {"model_limit": 1}, {"drift_size": 0}):
        with pytest.raises(ValueError):
            Params(**{"drift_threshold": 1, "drift_size": 5} | bad)
    with pytest.raises(ValueError):
        k = Kernel(Params(drift_threshold=1, drift_size=1))
        k.step(3, np.zeros(2))
        k.step(3, np.zeros(2))


@pytest.mark.parametrize("changes", [{}, {"algorithm": "v2"}, {"model_backend": "incremental"}, {"model_limit": 2}])
def test_a_kernel_kept_and_loaded_goes_on_as_before(changes):
    x = spells(5)
    p = Params(**{"drift_threshold": 4.0, "drift_size": 8, "model_mem": 20} | changes)
    _, want = run(x, p)
    k, out = Kernel(p), []
    for t, r in enumerate(x):
        if t % 17 == 0:
            k = Kernel.load(k.dump())
        out += k.step(t, r)
    assert out + k.close() == want


def test_an_incremental_model_needs_more_than_one_direction():
    x = np.concatenate([spells(1, n=2, parts=((0, 20),)), 30 + np.arange(8.0)[:, None] * [1, 1], [[30.0, 44.0]], 30 + np.arange(4.0)[:, None] * [1, 1]])
    k, out = run(x, Params(drift_threshold=4.0, drift_size=5, model_mem=20, model_backend="incremental"))
    assert [c for _, c, _, _ in sorted(out)][:29] == [1] * 20 + [2] * 9
