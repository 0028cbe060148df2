"""Reports read all rows."""

import __spark_entry__ as entry
from thicket.session import table


def test_sarif_results_of_all_snapshots(spark, folder):
    got = entry.queries()["sarif_results_by_snapshot"](spark, folder).groupBy("snapshot_no").count().collect()
    want = table(spark, folder, "findings").groupBy("snapshot_no").count().collect()
    assert len(want) > 1 and sorted(map(tuple, got)) == sorted(map(tuple, want))
