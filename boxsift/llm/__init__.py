"""Training-data operators: filters, joins, samplers, classifiers and outputs over documents and pages."""
