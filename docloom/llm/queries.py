"""Registered queries of the text problems, with their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import q_groups, q_lines, q_mainbody, q_mixing, q_neighbours, q_packing, q_splitting, q_subjects

_MODULES = (q_lines, q_splitting, q_groups, q_neighbours, q_mainbody, q_packing, q_mixing, q_subjects)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
