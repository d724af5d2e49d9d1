"""Whole jobs built from the operators: analysis of a source tree, rendering, and the registered queries."""
