"""The registered popularity cap is the library's: a decoy URL of more than 30 agents still links them."""
from __future__ import annotations

import datetime

from rebuff.operators import bridges
from rebuff.plans import bridge_queries


def test_popular_decoy_links(spark):
    decoy = spark.createDataFrame([(f"a{k:02d}", "u", 1) for k in range(35)], "uh_a_id string, uh_u_id string, uh_total long")
    deaths = spark.createDataFrame([("a00", datetime.date(2024, 1, 1))], "a_id string, t_death date")
    got = bridges.decoy_bridge(decoy, deaths, bridge_queries.CAP).collect()
    assert bridge_queries.CAP == bridges.POP_CAP == 1000 and len(got) == 34
