"""One row of every group of copies stays, also of rows with repeated ids or none."""

from test_llm_rows import frame

from webloom.llm import exact_dedup


def test_repeated_and_null_ids(spark):
    texts = [(7, "one two")] * 50 + [(None, "one two")] * 3 + [(None, "a b"), (None, "ab"), (None, "a b"), (8, "three"), (9, "three"), (8, "other"), (None, None), (None, "")]
    kept = exact_dedup.drop_copies(frame(spark, [(i, t, None, "s", 0) for i, t in texts]))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("7", "one two"), ("8", "other"), ("8", "three"), ("None", ""), ("None", "a b")]
