from pyspark.sql import functions as F

from wirelake.llm.common import ARROW_BYTES, stage


def test_a_stage_hands_small_batches_to_python(spark):
    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.nbytes], "rows": [b.num_rows]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("near copy "), 10_000).alias("text"))  # 40 MB
    found = stage(texts.mapInArrow(sizes, "n long, rows long"), "sizes").collect()
    assert sum(r["rows"] for r in found) == 400
    assert max(r["n"] for r in found) < 2 * ARROW_BYTES
    assert spark.conf.get(key) == before
