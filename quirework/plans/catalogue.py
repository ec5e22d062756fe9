"""All queries of the document engine, and their SQL."""

from __future__ import annotations

from quirework.plans import eval_queries, layout_queries, paper_queries, text_queries

_PARTS = (layout_queries, text_queries, eval_queries, paper_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
