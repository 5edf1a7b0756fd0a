"""All registered queries of the risk engine and their SQL."""

from __future__ import annotations

from riskweave.plans import catalogue, dictionary, disclosures, records

FLAGSHIP = catalogue.FLAGSHIP
_PARTS = (catalogue, disclosures, records, dictionary)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
