"""All registered queries and their SQL, and the checks on texts that aren't registered."""

from . import catalogue, code_queries, graph_queries, metric_queries, signature_queries, stream_queries, text_queries  # noqa: F401

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
FIXTURES, FIXTURE_ORACLES = catalogue.FIXTURES, catalogue.FIXTURE_ORACLES
