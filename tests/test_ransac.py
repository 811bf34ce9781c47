import numpy as np

from docforge.operators import ransac


def numpy_line(p, t, trials=ransac.TRIALS):
    p = sorted(p)
    n, best = len(p), None
    for h in range(trials):
        i = (h * 7919 + 42) % n
        j = (i + 1 + (h * 104_729 + 42) % (n - 1)) % n
        if p[i][0] == p[j][0]:
            continue
        s = (p[j][1] - p[i][1]) / (p[j][0] - p[i][0])
        c = p[i][1] - s * p[i][0]
        off = np.array([y - (s * x + c) for x, y in p])
        near = np.abs(off) <= t
        key = (-int(near.sum()), float((off[near] ** 2).sum()), h)
        if best is None or key < best[0]:
            best = (key, near)
    if best is None:
        return None
    x, y = np.array(p)[best[1]].T
    slope, intercept = np.polyfit(x, y, 1) if len(set(x)) > 1 else (0, 0)
    return slope, intercept, int(best[1].sum()), float(np.std(y - slope * x - intercept))


def test_against_numpy_in_any_order(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(40):
        n = int(rng.integers(4, 60))
        x = np.sort(rng.uniform(0, 500, n))
        y = 0.02 * g * x + 100 + rng.normal(0, 0.2, n)
        off = rng.random(n) < 0.3
        y[off] += rng.uniform(5, 60, off.sum())
        want[g] = numpy_line(list(zip(x.tolist(), y.tolist())), 1.0)
        rows += [(g, float(a), float(b), 1.0) for a, b in zip(x, y)]
    rows += [(90, 1.0, 2.0, 1.0), (91, 1.0, 2.0, 1.0), (91, 1.0, 5.0, 1.0), (92, 0.0, 0.0, 1.0), (92, 1.0, 1.0, 1.0), (92, None, 3.0, 1.0)]
    d = spark.createDataFrame(rows, "g int, x double, y double, t double")
    for parts in (1, 5):
        got = {r.g: r for r in ransac.ransac_lines(d.repartition(parts), ["g"], "t").collect()}
        assert set(got) == {*want, 92}
        for g, (slope, intercept, inliers, std) in want.items():
            assert got[g].inliers == inliers and abs(got[g].slope - slope) < 1e-6 and abs(got[g].intercept - intercept) < 1e-4 and abs(got[g].inlier_std - std) < 1e-6
        assert (got[92].slope, got[92].intercept, got[92].n) == (1.0, 0.0, 2)


def test_glyphs_off_their_line(spark):
    line = [("a", 10.0 * i, 100 + 0.1 * 10 * i, 12.0, "reliable", 1.0, 0.95, str(i)) for i in range(12)]
    odd = [
        ("a", 33.0, 100 + 3.3 + 9, 12.0, "reliable", 1.0, 0.9, "low"), ("a", 44.0, 100 + 4.4 - 7, 12.0, "reliable", 1.0, 0.5, "high"), ("a", 55.0, 100 + 5.5 + 5, 12.0, "uncertain", 1.0, 0.9, "hangs"),
        ("a", 56.0, 100 + 5.6 - 8, 12.0, "uncertain", 1.0, 0.9, "rises"), ("a", 66.0, 100 + 6.6 + 20, 12.0, "excluded", 1.0, 0.9, "passed"), ("a", 77.0, 100 + 7.7 + 2, 12.0, "reliable", 1.0, 0.9, "near"),
        ("b", 0.0, 1.0, 9.0, "reliable", 1.0, 1.0, "x"), ("b", 1.0, 50.0, 9.0, "reliable", 1.0, 1.0, "y"), ("b", 2.0, 1.0, 9.0, "reliable", 1.0, 1.0, "z"),
    ]
    d = spark.createDataFrame(line + odd, "l string, x double, bottom double, height double, class string, confidence double, char_confidence double, id string")
    got = {r.id: r.anomaly_confidence for r in ransac.baseline_outliers(d, ["l"]).collect()}
    assert got == {"low": 0.75, "high": 0.5, "rises": 0.75}  # three anchors are too few for a line
