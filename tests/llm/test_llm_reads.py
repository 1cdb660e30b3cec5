"""What the queries read, and what a task holds."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from facetry.llm import queries as Q
from facetry.llm import toxicity


def test_urls_and_times_cost_no_page(spark, tmp_path):
    pq.write_table(
        pa.table({"page_id": [1, 5, 7], "url": ["http://a/", None, "http://b/"], "html": ["<p>x", None, "é"]}),
        tmp_path / "pages.parquet",
    )
    records = Q.web_records(spark, str(tmp_path))
    slim = records.select("record_id", "url", "ts", "kind")
    assert "html" not in slim._jdf.queryExecution().executedPlan().toString()
    kinds = {r["record_id"]: r["kind"] for r in slim.collect()}
    assert kinds == {3 * p + i: "revisit" if i else "response" for p in (1, 5, 7) for i in range(3)}
    found = {r["record_id"]: r["headers"] for r in records.collect()}
    assert found[21]["Content-Length"] == "2" and found[22]["ETag"] == "W/" + found[21]["ETag"]
    assert found[15]["ETag"] is None and found[17]["ETag"] == "other" and set(found[23]) == {"Date"}


def test_shards_learn_from_small_batches(spark):
    texts = [f"word{i % 7} " * 30 + ("bad stuff " * 9 if i % 3 == 0 else "fine day ") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    total: dict[int, float] = {}
    for shard in range(2):
        ids = sorted((i for i in range(90) if order[i] % 2 == shard), key=order.get)
        rows = []
        for i in ids:
            data = np.frombuffer(texts[i].encode(), np.uint8)
            rows.append(np.unique(toxicity.features(data, np.array([0, len(data)]))[0]))
        for feature, w in zip(*toxicity.ftrl(rows, np.array([float(i % 3 == 0) for i in ids]))):
            if w:
                total[int(feature)] = total.get(int(feature), 0.0) + w / 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index, weights = toxicity.train(docs, labels, shards=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert total and sorted(total) == index.tolist()
    assert np.allclose([total[i] for i in sorted(total)], weights)
