"""A step that is written out leaves no garbage in the driver."""

import gc
import time

from gridlake.llm import common


def test_save_gives_back_the_drivers_memory(spark, monkeypatch):
    scratch = common.Scratch(spark, "driver")
    jvm = spark.sparkContext._jvm
    held = jvm.java.util.ArrayList()
    weak = jvm.java.lang.ref.WeakReference(held)
    jvm.java.lang.System.gc()  # into the old generation, which no collection of young objects reaches
    del held
    gc.collect()
    time.sleep(2)  # py4j lets go of it in a thread of its own
    monkeypatch.setattr(common, "_trimmed", 0.0, raising=False)
    out = scratch.save(spark.range(5), "rows")
    assert weak.get() is None  # collected
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4]
    scratch.release()


def test_trim_reaches_the_native_heap(spark, monkeypatch):
    monkeypatch.setattr(common, "_trimmed", 0.0)
    assert common.trim_driver(spark).startswith("Trim native heap")
    assert common.trim_driver(spark) is None  # not again so soon
