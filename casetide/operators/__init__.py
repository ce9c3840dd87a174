"""Table operators: cleaning, case versions, filters, joins, question log."""
