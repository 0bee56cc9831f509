"""Training-data operators: filters, fingerprints, joins, packing, archives."""
