from sieveline.llm import decontamination


def test_decontamination_tells_rows_with_one_id_apart(spark):
    passage = " ".join(f"word{n}" for n in range(20))
    rows = [(None, "clean one"), (None, f"before {passage} behind"), (None, None), (7, "clean seven"), (7, passage), (8, "clean eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontamination.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[n] for n in (0, 2, 3, 5)]))
