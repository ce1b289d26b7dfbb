"""The queries over deaths take those of both arms."""
import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def test_deaths_of_both_arms(spark):
    died = {r.a_id for r in entry.queries()["persistent_deaths"](spark, SF).collect()}
    assert {a % 2 for a in died} == {0, 1}
    assert {r.a_id for r in entry.queries()["date_window_stats"](spark, SF).collect()} == died
    paired = {r.a_death for r in entry.queries()["pair_event_study"](spark, SF).collect()}
    assert paired <= died and {a % 2 for a in paired} == {0, 1}
