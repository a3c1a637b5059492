"""Plumbing of the text operators."""

import pyarrow as pa

from riskspark.llm import texts


def maker():
    # Made here, so that workers, who can't import the tests, get it by value.
    def lengths():
        return lambda found: [pa.array([len(t) for t in found], pa.int64())]

    return lengths


def test_a_kept_text_is_sent_once(spark):
    """A kept text used to go to the workers twice, as text and as bytes."""
    docs = spark.createDataFrame([(1, "añ€"), (2, None), (3, "")], "doc_id long, text string")
    made = texts.map_texts(docs, maker(), "n long")
    assert texts.TEXT_IN not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == ["doc_id", "text", "n"]
    assert sorted(tuple(r) for r in made.collect()) == [(1, "añ€", 6), (2, None, 0), (3, "", 0)]


def test_texts_of_other_types_or_not_kept(spark):
    docs = spark.createDataFrame([(1, b"\xff\x00", "ab"), (2, None, None)], "doc_id long, text binary, other string")
    rows = sorted((r["doc_id"], r["text"] and bytes(r["text"]), r["n"]) for r in texts.map_texts(docs, maker(), "n long").collect())
    assert rows == [(1, b"\xff\x00", 2), (2, None, 0)]
    one = texts.map_texts(docs, maker(), "n long", "other", ["doc_id"])
    assert one.columns == ["doc_id", "n"] and sorted(r["n"] for r in one.collect()) == [0, 2]
    # A result with the text's name takes its place.
    replaced = texts.map_texts(docs, maker(), "other long", "other")
    assert replaced.columns == ["doc_id", "text", "other"] and sorted(r["other"] for r in replaced.collect()) == [0, 2]
