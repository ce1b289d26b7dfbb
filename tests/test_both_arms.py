"""The nine queries over deaths leave out no arm, in code and SQL."""
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
NAMES = ("date_window_stats", "pair_event_study", "pair_placebo", "transfer_summary", "transfer_rates", "eligible_null_dates",
         "link_permutation_null", "specificity_partition", "leave_date_out")


@pytest.mark.parametrize("name", NAMES)
def test_sql_restricts_no_deaths(name):
    sql = entry.oracle_sql()[name]
    deaths = sql[sql.index("deaths AS ("):]
    assert "arm='abusive'" not in deaths[:deaths.index("GROUP BY a_id")]


def test_rates_and_placebo_are_over_all_deaths(spark):
    q = entry.queries()
    died = q["persistent_deaths"](spark, SF).count()
    assert {r.n_deaths for r in q["transfer_rates"](spark, SF).collect()} == {died}
    assert {r.a_death % 2 for r in q["pair_placebo"](spark, SF).collect()} == {0, 1}
