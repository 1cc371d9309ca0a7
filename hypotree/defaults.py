"""Parameters that the engine's rules leave open, in one place."""

TAU = 0.15  # least |cos| of evidence
TAU_LINK = 0.25  # least cos of linked theories' nodes
DEPTH, BRANCH = 4, 3  # budgets of a tree
K = 5
PRUNE_FLOOR = 0.2
ACTIVE_FLOOR = 0.5
WEIGHTS = (0.50, 0.35, 0.15)  # resilience, plausibility, novelty
CUT = "2024-01-01 10:00:00"  # last scoring time of the fixtures

#: lens_no, lens, concern_at, fail_at, weight
LENSES = [
    (1, "source_reliability", 0.15, 0.25, 1.0),
    (2, "confirmation_bias", 0.05, 0.15, 1.0),
    (3, "denial_deception", 0.10, 0.20, 1.0),
    (4, "competing_hypotheses", 0.50, 0.99, 1.0),
    (5, "incentive_analysis", 0.01, 0.03, 1.0),
    (6, "logical_coherence", 0.45, 0.70, 1.0),
    (7, "base_rate", 0.25, 0.60, 1.0),
]
