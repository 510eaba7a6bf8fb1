"""All registered queries and their reference SQL."""

from gridloom.plans import evaluation, geometry, tables

QUERIES = {**geometry.QUERIES, **evaluation.QUERIES, **tables.QUERIES}
ORACLES = {**geometry.ORACLES, **evaluation.ORACLES, **tables.ORACLES}
