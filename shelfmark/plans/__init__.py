"""Multi-table results built from the operators."""
