"""The training sample is one of documents, however often their ids are repeated."""

from riskcard.llm import toxicity


def test_repeated_ids_do_not_shrink_the_sample(spark):
    ids = [i for i in range(200) for _ in range(4)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(7, "text 7")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    rows, _ = toxicity.sample(docs.repartition(3), labels, 10, 50)
    assert rows.where("not toxic").count() == 50
