"""Two texts under one doc_id: near copies of either are linked."""

import random

from terrafold.llm import neardup

from .cases import DOCS


def test_near_copies_of_every_text_of_a_doc_id_are_linked(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    a, b = text(), text()
    rows = [(1, a, "", "", 1), (1, b, "", "", 1), (2, a + " enda", "", "", 1), (3, b + " endb", "", "", 1), (4, text(), "", "", 1)]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
