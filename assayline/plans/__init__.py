"""Whole analyses composed from the operators, and the places to plug in your own parts."""
