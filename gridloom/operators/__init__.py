"""Order-dependent reductions, joins, metrics and clustering over box tables."""
