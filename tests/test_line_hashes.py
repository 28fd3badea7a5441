"""Line hashes behind the change detection."""

from filinglens.operators import metrics


def test_line_hashes_of_null_and_repeated_ids(spark):
    rows = [(None, "a\nb")] * 50 + [(1, "a\nb")] * 40 + [(1, "b\nc"), (1, ""), (2, "a\na"), (3, None), (4, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: len(r["h"]) for r in metrics.line_hashes(df, "doc_id", "text").collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 0}
