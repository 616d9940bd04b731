import pytest

from inboxlens.fixtures import views as V
from inboxlens.operators import clusters as CL
from inboxlens.operators import senders as SN
from tests.conftest import SF001
from tests.fixtures import f1


def test_k3_on_f1(spark):
    c = {r["from"]: r.cluster for r in CL.cluster_senders(f1(spark), 3).collect()}
    assert len(c) == 5 and set(c.values()) <= {0, 1, 2} and len(set(c.values())) == 3


def test_edge_cases(spark):
    assert {r.cluster for r in CL.cluster_senders(f1(spark), 1).collect()} == {0}
    assert CL.cluster_senders(f1(spark).limit(2), 5).count() == 0
    assert CL.cluster_senders(f1(spark).limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        CL.cluster_senders(f1(spark), 0)


def test_standardize_population(spark):
    z = CL.standardize(CL.feature_table(f1(spark)))
    stats = z.selectExpr("avg(total_volume) m", "stddev_pop(total_volume) s").first()
    assert abs(stats.m) < 1e-9 and abs(stats.s - 1) < 1e-9
    const = spark.createDataFrame([("a", 3, 1, 0.0, 7.0), ("b", 3, 2, 0.0, 8.0)],
                                  "from string, total_volume long, unread_count long, open_rate double, "
                                  "ignorance_score double")
    assert {r.total_volume for r in CL.standardize(CL.feature_table(const)).collect()} == {0.0}


def test_properties_on_orders(spark):
    s = SN.aggregate_and_score(V.mail_orders(spark, SF001))
    k = 5
    c = CL.cluster_senders(s, k, starts=3)
    rows = c.collect()
    assert len(rows) == s.count() and len({r["from"] for r in rows}) == len(rows)
    assert {r.cluster for r in rows} == set(range(k))
    stats = CL.cluster_stats(c, s).collect()
    opens = [r.avg_open_rate for r in stats]
    assert opens == sorted(opens)                      # stable ids: worst open rate is cluster 0
    assert [r.cluster for r in stats] == list(range(k))
    top = CL.top_per_cluster(c, s, 5).collect()
    assert all(r.rank <= 5 for r in top) and len(top) <= 5 * k

    # the assignment costs what the cheapest start costs
    again, costs = CL.cluster_senders_with_costs(s, k, starts=3)
    cost = CL.cost_of(again, s).first()
    assert len(costs) == 3 and abs(cost["cost"] - min(costs)) <= 1e-6 * min(costs) and cost["cost"] < cost["one_cluster_cost"]
