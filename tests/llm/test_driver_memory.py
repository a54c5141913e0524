"""What the driver's JVM no longer uses outside its heap goes back to the system."""

import re
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from modelloom.llm import common


def _mb(pid):
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def _left(spark, n=600):
    """Native memory in small pieces, all given back to malloc but for one in twenty."""
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(n)]
    for k, d in enumerate(made):
        if k % 20:
            d.end()
    return made[::20]


def test_native_memory_goes_back(spark):
    if hasattr(common, "trimmed") and not common.trimmed(spark):
        pytest.skip("this JVM can't")
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    spark._jvm.System.gc()
    before = _mb(pid)
    kept = _left(spark)
    full = _mb(pid)
    common.released(spark)
    after = _mb(pid)
    for d in kept:
        d.end()
    assert full - after > 0.5 * (full - before)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_begin_with_it(spark, monkeypatch, name, stage):
    def seen(spark):
        raise InterruptedError

    monkeypatch.setattr(pipeline, "released", seen, raising=False)
    with pytest.raises(InterruptedError):
        stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "/nowhere")
