"""DataFrame operators: anchoring, labelling, aggregation, enrichment."""
