"""The style sums of every text by one pass of patterns and by Column expressions."""

import pytest

from corpusloom.operators import style
from corpusloom.sources.tables import conversations, documents

CASES = [
    ("# Head\n\nOne, two; three: four -- five. \"Six seven eight nine ten.\" It's 12 o'clock! And so?\n\n| a | b |\n| c | d |\n\n> quote\n\nSources\n\nAfter it.", "en"),
    ("---\ntitle: x\n---\nVielleicht gibt's das. Und dann – nicht. <!-- gone -->", "de"), ("", "en"), (None, "fr"), ("Perhaps it may be. But 3 words", "xx"),
]


@pytest.mark.parametrize("rows", [lambda s: documents(s, "/root/testdata/sf0.001"), lambda s: conversations(s, "/root/testdata/sf0.001"), lambda s: s.createDataFrame([(i, t, c, "t") for i, (t, c) in enumerate(CASES)], "key int, text string, lang string, type string")])
def test_both_forms_of_the_scan_agree(spark, rows):
    texts = rows(spark)
    found = [{r["key"]: tuple(r[c] for c in style.SUMS) for r in f(texts).collect()} for f in (style.sums, style.sums_by_columns)]
    assert found[0] == found[1] and len(found[0]) == texts.count()
