"""Training-data operators: media columns, joins, search, tokenizing, mixing, scoring."""
