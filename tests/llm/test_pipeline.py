"""The pipeline's stages, each on its own, on a table with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from modelloom.llm.common import saved


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    draw = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    item = draw(20)
    base = draw(300)
    docs = [(i, draw(120), "en", f"s{i % 3}", 0) for i in range(40)]
    docs += [(100, base, "en", "s0", 0), (101, base, "en", "s1", 0), (102, base.replace(base.split()[7], "zzzzz"), "en", "s1", 0)]
    docs += [(200, draw(50) + " " + item + " " + draw(50), "en", "s2", 0), (300, "123 ... !!", "en", "s0", 0), (301, None, "en", "s0", 0), (302, "", None, None, 0)]
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, planted), name)
        kept.append({r.doc_id for r in docs.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = set(range(40))
    assert kept[0] == clean | {100, 101, 102, 200} and kept[1] == clean | {100, 200} and kept[2] == clean | {100}
    assert kept[4] <= kept[3] <= kept[2]
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    assert pipeline.run(spark, planted).count() == docs.count()


def test_empty(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, planted), name)
        assert docs.count() == 0
