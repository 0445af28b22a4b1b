"""Query plans: checkpoints and the registered queries."""
