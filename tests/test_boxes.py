"""Boxes that meet, against plain Python, and the number of tasks they get."""

from papyra.plans import series
from papyra.plans.catalog import QUERIES


def test_iou_match_and_its_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(series, "BOXES_PER_TASK", 10)
    part = [(k, f"B{k % 3}", 1 + (7 * k) % 50) for k in range(1, 260) if k % 11 or k % 2 == 0] + [(1000, "alone", 5)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    boxes = [(k, (k // 200, b), (k % 40, k % 17, k % 40 + n, k % 17 + 10)) for k, b, n in part]
    want = {}
    for i, page, (l, t, r, b) in boxes:
        if i % 2:
            continue
        best = (0.0, None)
        for j, other, (l2, t2, r2, b2) in boxes:
            x = max(0, min(r, r2) - max(l, l2)) * max(0, min(b, b2) - max(t, t2))
            iou = x / ((r - l) * (b - t) + (r2 - l2) * (b2 - t2) - x)
            if j % 2 and other == page and (iou, -j) > (best[0], -(best[1] or 0)) and iou > 0:
                best = (iou, j)
        want[i] = (best[1], round(best[0], 9))
    frame = QUERIES["iou_match"](spark, str(tmp_path))
    assert {r.a_id: (r.b_id, r.iou) for r in frame.collect()} == want and want[1000] == (None, 0.0)
    # the sorts of the join can't be split: their tasks are as many as the boxes need
    assert f", {-(-len(part) // 10)}), REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString()
