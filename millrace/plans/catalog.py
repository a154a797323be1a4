"""The registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

from millrace.plans.register import ORACLES, QUERIES

for _module in ("retrieval", "textual", "documents", "extras", "services", "files", "indexes"):
    import_module(f"millrace.plans.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def flagship(spark, sf_dir: str):
    return QUERIES["bm25_topk"](spark, sf_dir)
