"""Column builders: text measures, scores, validators, addresses."""
