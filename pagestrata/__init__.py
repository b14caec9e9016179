"""Site-structure analytics on Spark: platforms, page blocks, labels, link graph, reports."""
