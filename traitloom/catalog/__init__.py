"""Registered queries over the test tables, each next to the SQL that checks it."""

from traitloom.catalog import base

from traitloom.catalog import disease, files, ld, qtl, relational, sheets, sumstat, traits, variants  # noqa: E402,F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
