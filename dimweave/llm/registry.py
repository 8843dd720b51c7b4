"""Queries and SQL of this subpackage."""

from . import ann, fingerprints, jaccard_join, language_id, licenses, line_dedup, mixing, packing, suffixes, url_filters

_MODULES = (licenses, mixing, packing, jaccard_join, line_dedup, fingerprints, ann, language_id, suffixes, url_filters)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
