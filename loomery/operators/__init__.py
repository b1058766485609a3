"""Relational operators: filters, joins, facets, rankings, reports and mutations."""
