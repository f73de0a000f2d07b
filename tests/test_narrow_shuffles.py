from pathlib import Path

import pytest

from strandline.operators import networks
from strandline.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_edges_are_grouped_by_the_keys_of_the_line_items(spark):
    plan = registry.site_edges(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(dealt) == 1 and "l_suppkey" in dealt[0] and "l_partkey" in dealt[0]


def test_only_numbers_are_spread_over_the_lengths(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("::ffff:10.1.2.3",), ("10.1.2.3",), ("fd00::1",), ("nonsense",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("fd00::/8",)], "net string")
    found = networks.match(ips, nets)
    assert sorted(map(str, (r.net for r in found.collect()))) == ["10.1.0.0/16"] * 3 + ["None"] * 2 + ["fd00::/8"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the address as it is written does not go through the join
    joined = [line for line in plan.splitlines() if "max_by" in line]
    assert joined and all("_matched" not in line for line in joined)
