"""Python workers hold bounded batches, whatever the size of a table."""

from __future__ import annotations

import pandas as pd

from lumenloom.runtime import tune


def test_batches_are_bounded_in_rows_and_bytes(spark):
    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "bytes": [sum(map(len, pdf["text"]))]})

    tune(spark)
    for width, rows in ((10, 5_000), (100_000, 400)):
        texts = spark.range(0, rows, 1, 1).selectExpr(f"repeat('x', {width}) AS text")
        got = texts.mapInPandas(sizes, "n int, bytes long").collect()
        assert sum(r["n"] for r in got) == rows
        assert max(r["n"] for r in got) <= 1_000 and max(r["bytes"] for r in got) <= 9 << 20
