"""DataFrame operators: recipes, joins, group statistics, pivots, latest rows, last-k."""
