"""Working on tables whose columns may have any name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to c0_, c1_ and so on, which no operator uses, and the new name of each; undo by toDF."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
