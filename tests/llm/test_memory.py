"""What the pipeline leaves in executors' memory: one pool of Python workers, one map a hash aggregate."""

import public_tokenizers
import pytest

import corpus_pipeline
from tessel.llm.packing import pack
from tessel.runtime import one_map

TWO_LEVEL = "spark.sql.codegen.aggregate.map.twolevel.enabled"
COLUMNS = "doc_id long, text string, lang string, source string"


def test_plan_of_packing_needs_no_python_on_executors(spark, monkeypatch):
    made, kind = [], type(spark)
    make = kind.createDataFrame
    docs = make(spark, [(i, "some words " * (i + 1), "en", "web") for i in range(20)], COLUMNS)
    monkeypatch.setattr(kind, "createDataFrame", lambda self, *a, **b: made.append(make(self, *a, **b)) or made[-1])
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(out) == 20 and len({(r["sequence_id"], r["offset"]) for r in out}) == 20
    assert made and not any("Python" in df._jdf.queryExecution().toRdd().toDebugString() for df in made)


def test_packing_without_pieces_to_place(spark):
    assert pack(spark.createDataFrame([], COLUMNS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_aggregate_in_one_map(spark, stage):
    session = spark.newSession()
    assert session.conf.get(TWO_LEVEL, None) is None
    docs = session.createDataFrame([(1, "a b c", "en", "web")], COLUMNS)
    assert stage(session, docs, "").count() == (stage is not corpus_pipeline.quality_rules)
    assert session.conf.get(TWO_LEVEL) == "false"


def test_a_session_may_name_its_maps(spark):
    session = spark.newSession()
    session.conf.set(TWO_LEVEL, "true")
    one_map(session)
    assert session.conf.get(TWO_LEVEL) == "true"
