"""The library's queries by name, and their SQL."""

from . import analytics, detection, documents_in, flow, lines, nested, profiles, records

MODULES = (records, analytics, lines, detection, documents_in, profiles, nested, flow)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
