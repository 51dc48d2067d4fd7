"""All queries of the library by name, and the SQL for each."""

from __future__ import annotations

from . import evaluation, generation, graphs, notation, ontology, reasoning, search, stages, supports, texts

QUERIES = texts.QUERIES | supports.QUERIES | graphs.QUERIES | search.QUERIES | evaluation.QUERIES | stages.QUERIES | notation.QUERIES | ontology.QUERIES | generation.QUERIES | reasoning.QUERIES
ORACLE_SQL = texts.ORACLE_SQL | supports.ORACLE_SQL | graphs.ORACLE_SQL | search.ORACLE_SQL | evaluation.ORACLE_SQL | stages.ORACLE_SQL | notation.ORACLE_SQL | ontology.ORACLE_SQL | generation.ORACLE_SQL | reasoning.ORACLE_SQL
