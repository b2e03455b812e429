"""SQL models, model graphs and versioned tables."""
