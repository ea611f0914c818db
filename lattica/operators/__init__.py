"""DataFrame operators: ordered tables, joins, corpus processing, vectors, graphs and ordered state."""
