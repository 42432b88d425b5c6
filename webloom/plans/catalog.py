"""All queries and their SQL."""

from . import composition_oracle, composition_queries, dialogue_oracle, dialogue_queries, evidence_oracle, evidence_queries, facet_oracle, facet_queries, intel_oracle, intel_queries, markup_oracle, markup_queries, oracle, organisation_oracle, organisation_queries, profile_oracle, profile_queries, queries, report_oracle, report_queries, runner_oracle, runner_queries, small_oracle, small_queries, table_oracle, table_queries

QUERIES = queries.QUERIES | report_queries.QUERIES | intel_queries.QUERIES | facet_queries.QUERIES | markup_queries.QUERIES | table_queries.QUERIES | dialogue_queries.QUERIES | organisation_queries.QUERIES | runner_queries.QUERIES | composition_queries.QUERIES | evidence_queries.QUERIES | profile_queries.QUERIES | small_queries.QUERIES
ORACLE = oracle.ORACLE | report_oracle.ORACLE | intel_oracle.ORACLE | facet_oracle.ORACLE | markup_oracle.ORACLE | table_oracle.ORACLE | dialogue_oracle.ORACLE | organisation_oracle.ORACLE | runner_oracle.ORACLE | composition_oracle.ORACLE | evidence_oracle.ORACLE | profile_oracle.ORACLE | small_oracle.ORACLE
