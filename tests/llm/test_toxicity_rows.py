"""The toxicity model learns from 8000 labelled rows where there are so many."""

from pyspark.sql import functions as F

from furrow.llm import toxicity


def test_rows_beyond_6000_teach(spark):
    order = [r.id for r in spark.range(8000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[6000:])
    rows = [(i, "a vile word here" if i in late else "a plain word here") for i in order]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in late)) for i in order], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((scored[i] >= toxicity.THRESHOLD) == (i in late) for i in order)
