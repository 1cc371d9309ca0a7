"""A Spark engine for competing theories about events: evidence, trees of hypotheses, lenses, scores, refinement."""
