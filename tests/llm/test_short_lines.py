"""Lines of fewer words than a shingle, which op6 keeps by its rule and the pipeline does not."""

from tarncast.llm import line_dedup


def test_short_lines(spark):
    texts = [(1, "All rights reserved.\none two three four\n\nx"), (2, "all rights  reserved.\n\nrights reserved.\nx"), (3, "one two three four five\none two three four\n \nX\nx y")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    kept = {row.doc_id: row.kept for row in line_dedup.clean_lines(docs, short=True).collect()}
    assert kept == {1: texts[0][1], 2: "\nrights reserved.", 3: "one two three four five\n \nx y"}
    assert {row.kept for row in line_dedup.clean_lines(docs).collect()} == {text for _, text in texts}
