"""What a worker holds at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from trackloom.llm import common, language_id
from trackloom.llm.harmonic_packing import harmonic_pack

from .helpers import documents

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(BOUND)
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))  # 40 MB in one partition

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    got = common.map_batches(rows, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 4000
    assert max(r["bytes"] for r in got) <= common.SLICE_BYTES


def test_a_session_keeps_its_own_bound(spark):
    spark.conf.set(BOUND, "65536")
    try:
        common.map_batches(spark.range(1), lambda batches: batches, "id long")
        assert spark.conf.get(BOUND) == "65536"
    finally:
        spark.conf.unset(BOUND)


def test_packing_is_the_same_in_batches_of_any_size(spark):
    docs = documents(spark, [(i, f"{i} some words of a text " * (i % 97)) for i in range(400)]).coalesce(1)
    found = []
    for size in ("2048", "2000000", str(1 << 30)):
        spark.conf.set(BOUND, size)
        found.append(sorted(map(tuple, harmonic_pack(docs).collect())))
    spark.conf.unset(BOUND)
    assert found[0] == found[1] == found[2]


def test_training_starts_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    docs = documents(spark, [(i, f"the cat sat on mat {i}" if i % 2 else f"der hund und die katze {i}", "en" if i % 2 else "de") for i in range(80)])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert language_id.train(docs).languages == ["de", "en"]
