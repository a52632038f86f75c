"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from attesta.queries import assess, closure, curation, extra, files, joins, review, rules, scale, text

_MODULES = [curation, joins, assess, text, review, closure, rules, extra, files, scale]
FLAGSHIP = "q_p12_dispositions"
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
