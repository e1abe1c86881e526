"""Query plans over the standard tables."""
