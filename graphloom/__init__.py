"""Evidence-graph analytics on Spark: typed graphs, retrieval, rule checks, scoring, statistics and audits as DataFrame plans."""
