import numpy as np
import pytest

from vacantia.llm import whitening

pytestmark = pytest.mark.usefixtures("few_partitions")
SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, components=4):
    """Whole numbers, exact sums and eigenvectors of the dense covariance."""
    kept = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in kept]
    fit = np.array(sorted({tuple(r) for r in x}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array([s / n for s in sums])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = {}
    for (i, _), r in zip(kept, x, strict=True):
        dev = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        w = (np.array(r) - np.array([s / n for s in sums])) @ q / np.sqrt(e)
        for c in range(len(e)):
            out.setdefault((i, c + 1), []).append((n, dev, w[c], e[c] / (centred**2).sum() * n))
    return out


def agree(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE).repartition(3)
    model = whitening.fit(df)
    got, want = whitening.transform(df, model).collect(), brute(rows)
    assert len(got) == sum(map(len, want.values()))
    flip = {}
    for r in got:
        n, dev, w, share = next(t for t in want[(r.vec_id, r.component)] if t[1] == r.deviation)  # rows may share an id
        assert r.n == n
        sign = flip.setdefault(r.component, np.sign(r.whitened * w)) if abs(w) > 1e-6 else 1
        assert abs(r.whitened - (sign or 1) * w) < 1e-8 * (1 + abs(w))
        assert abs(r.explained - share) < 1e-10 and r.identity_error < 1e-9
    return got, model


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 40)) * np.linspace(3, 1, 40) @ rng.standard_normal((40, 40)) / 10
    rows = [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # copies count once in the fit
    rows += [(None, rows[1][1]), (2000, None), (2001, [*rows[0][1][:-1], None]), (2002, [*rows[0][1][:-1], float("nan")]), (2003, [*rows[0][1][:-1], float("inf")]), (7, rows[8][1])]
    assert len(agree(spark, rows)[0]) == 4 * 1002


def test_flat_spectrum_needs_few_passes(spark):
    x = np.random.default_rng(2).standard_normal((1500, 49)) * np.where(np.arange(49) < 1, 1.5, 1.0)
    _, w = agree(spark, [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(x)])
    assert w.passes < 120 and (w.residuals <= 16 * whitening.EPS * 7 * w.values[0]).all()
    assert np.abs(w.vectors.T @ w.vectors - np.eye(4)).max() < 1e-13


def test_widely_spread_spectrum(spark):
    x = np.random.default_rng(3).standard_normal((500, 30)) * 10.0 ** -np.linspace(-3, 1, 30)
    agree(spark, [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(x)])


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, 0), (2, [], 0)])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0  # one vector has no spread
    two = whitening.whiten(frame([(1, [1.0], 0), (2, [3.0], 0), (3, [3.0, 0.0], 0)])).collect()  # shorter ones are filled
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in two) == [(1, 1, 2, 512**2), (2, 1, 2, 512**2), (3, 1, 2, 512**2)]
    assert {abs(round(r.whitened, 12)) for r in two} == {1.0}
    huge = whitening.whiten(frame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert len({r.vec_id for r in huge}) == 3 and all(r.deviation is None for r in huge if r.vec_id != 3)
    clash = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 6)], "vec_id long, embedding array<double>, whitened int")
    assert whitening.whiten(clash).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
