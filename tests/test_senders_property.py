"""The sender aggregation against a brute-force pandas computation on random message tables."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inboxlens.operators import senders as SN

FLAGS = ["unread", "starred", "important", "social", "updates", "promotions"]

row = st.tuples(st.sampled_from(["a@x", "b@x", "c@x", "UPPER@X", None]),
                *[st.booleans() for _ in FLAGS],
                st.none() | st.integers(-3, 4000))


def brute(rows):
    df = pd.DataFrame(rows, columns=["from", *FLAGS, "age_days"])
    df["id"] = [f"m{i}" for i in range(len(df))]
    df = df.dropna(subset=["age_days", "from"])
    out = {}
    for sender, g in df.groupby("from"):
        total = len(g)
        unread = int(g["unread"].sum())
        open_rate = (total - unread) / total * 100
        out[sender] = (total, unread, *[int(g[f].sum()) for f in FLAGS[1:]], g["age_days"].mean(), open_rate,
                       total * (100 - open_rate))
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=0, max_size=60))
def test_aggregate_matches_brute_force(spark, rows):
    data = [(f"m{i}", r[0], *r[1:7], r[7]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, from string, " + ", ".join(f"{f} boolean" for f in FLAGS)
                               + ", age_days long")
    got = {r["from"]: r for r in SN.aggregate_and_score(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for s, w in want.items():
        g = got[s]
        assert (g.total_volume, g.unread_count, g.starred_count, g.important_count, g.social_count,
                g.updates_count, g.promotions_count) == w[:7]
        assert abs(g.avg_recency_days - w[7]) < 1e-9
        assert abs(g.open_rate - w[8]) < 1e-9 and abs(g.ignorance_score - w[9]) < 1e-6
