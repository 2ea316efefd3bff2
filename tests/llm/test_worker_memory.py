"""What a worker keeps between its tasks."""

import pyarrow as pa
from loomgraph.llm import common
from loomgraph.llm.sentencepiece_codec import MODEL, _codec, encoder
from loomgraph.llm.spm import Vocabulary


def test_units_of_a_task_go_with_it():
    vocabulary = Vocabulary.read(MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], names=["id", "text"])
    assert [b.num_rows for b in _codec(vocabulary)(iter([batch]))] == [2]
    assert not encoder(vocabulary).place and not len(encoder(vocabulary).flat)


def test_the_driver_gives_back_memory_when_a_table_is_written(spark, monkeypatch):
    assert common.trim_driver(spark)
    seen = []
    monkeypatch.setattr(common, "trim_driver", seen.append)
    monkeypatch.setattr(common, "_last_trim", -common.TRIM_EVERY)
    work = common.Workspace(spark, "trim")
    work.save(spark.range(3))
    work.save(spark.range(3))
    work.close()
    assert seen == [spark]  # not again at once
