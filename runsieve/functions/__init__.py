"""Column expressions: patterns, text, classifiers, report columns."""
