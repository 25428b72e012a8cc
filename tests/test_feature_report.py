import math

from tickerloom.operators import features


def test_report_by_category_from_rows_written_once(spark, make_bars):
    bars = make_bars({f"T{k}": [100 + 10 * k + 5 * math.sin(0.3 * i + k) for i in range(80)] for k in range(3)})
    out, report = features.compute_and_validate(bars)
    assert report.inputFiles()  # no category works out the others' series again
    want = features.feature_report(out, features.list_features())
    key = lambda r: r["feature"]
    assert sorted(report.collect(), key=key) == sorted(want.collect(), key=key)
