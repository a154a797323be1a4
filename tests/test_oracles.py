"""Every query of the engine with SQL gives the rows of that SQL; the others give rows."""

import pandas as pd
import pytest
from support import DATA, compare

from millrace.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_block_chunks_of_odd_documents(spark, tmp_path):
    ids = [0, 1, 2, 3, 4, 7, 7, 8, 8, -5, None, None]
    texts = ["plain", None, "", "   ", "\n \t", "first", "second", "same", "same", "negative", "no id", None]
    pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "text": texts}).to_parquet(tmp_path / "documents.parquet", index=False)
    compare(spark, catalog.queries()["block_chunks"], catalog.oracle_sql()["block_chunks"], str(tmp_path))


def test_entry_imports_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert "bm25_topk" in entry.queries() and "pipeline" not in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
