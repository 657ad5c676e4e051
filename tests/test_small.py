"""Frames of a few rows of the driver's."""

from papyra.plans.catalog import QUERIES
from papyra.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_small_frames_start_no_python_worker(spark):
    t = Tables(spark, SF)
    assert [tuple(r) for r in t.small([("a", 1), (None, None)], "x string, y int").collect()] == [("a", 1), (None, None)]
    none = t.small([], "x string, y int")
    assert none.count() == 0 and none.schema.simpleString() == "struct<x:string,y:int>"
    got = QUERIES["diagonal_order"](spark, SF)
    assert got.schema.simpleString() == "struct<side:string,pos:int,name:int>"
    # a frame made from a list is an RDD that a Python worker hands through
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
