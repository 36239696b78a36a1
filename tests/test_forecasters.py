"""Model-based forecasters against numpy brute force on a few samples."""
import numpy as np

SF = "/root/testdata/sf0.001"


def _ets_numpy(x, k=3, H=16, a=0.5, b=0.5, phi=0.9):
    L = len(x)
    X = np.fft.rfft(x)
    amp = np.abs(X)
    cand = [f for f in range(1, len(X)) if not (L % 2 == 0 and 2 * f == L)]
    cand.sort(key=lambda f: (-amp[f], f))
    t = np.arange(L + H)
    season = sum(2.0 / L * (X[f].real * np.cos(2 * np.pi * f * t / L) - X[f].imag * np.sin(2 * np.pi * f * t / L))
                 for f in cand[:k])
    d = x - season[:L]
    lv = [d[0]]
    for v in d[1:]:
        lv.append((1 - a) * lv[-1] + a * v)
    g = np.diff(lv)
    gs = [g[0]]
    for v in g[1:]:
        gs.append((1 - b) * gs[-1] + b * v)
    h = np.arange(1, H + 1)
    return lv[-1] + gs[-1] * phi * (1 - phi ** h) / (1 - phi) + season[L - 1 + h]


def test_ets_compose_matches_numpy(spark):
    import __spark_entry__ as E
    from tsq.sources import tables as tb
    got = E.queries()["ets_compose_forecast"](spark, SF).toPandas()
    emb = tb.read(spark, SF, "embeddings").orderBy("vec_id").limit(3).collect()
    for row in emb:
        exp = _ets_numpy(np.asarray(row["embedding"], dtype=float))
        g = got[got.sample_id == row["vec_id"]].sort_values("h")["y_hat"].to_numpy()
        np.testing.assert_allclose(g, exp, atol=2e-6)


def test_dmd_kernel_identity_on_periodic():
    from tsq.plans.udf import dmd_kernel
    x = np.tile(np.arange(8, dtype=float), 8)
    out = dmd_kernel(x)
    assert out.shape == (16,) and np.all(np.isfinite(out))
