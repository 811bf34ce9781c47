import random
import statistics

from docforge.operators import stats


def test_both_ways_are_exact_and_null_keys_are_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([rng.gauss(0, 5), float(rng.randrange(4)), None])) for _ in range(600)] + [("one", 0, 2.5), ("none", 0, None), (None, None, 1.0)]
    groups = {}
    for a, b, v in rows:
        if v is not None:
            groups.setdefault((a, b), []).append(v)
    want = {}
    for k, v in groups.items():
        m = statistics.median(v)
        want[k] = (len(v), round(m, 9), round(statistics.median(abs(x - m) for x in v), 9))
    d = spark.createDataFrame(rows, "a string, b int, v double").repartition(4)
    for most in (100_000, 50, 0):
        got = {(r.a, r.b): (r.n, round(r["median"], 9), round(r.mad, 9)) for r in stats.medians(d, ["a", "b"], "v", most).collect()}
        assert got == want
    z = stats.with_mad(d, ["a", "b"], "v", least=5).collect()
    assert len(z) == sum(len(v) for k, v in groups.items() if len(v) >= 5) + sum(v is None and len(groups.get((a, b), [])) >= 5 for a, b, v in rows)
    assert any(r.a is None for r in z)
