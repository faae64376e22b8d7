"""Compositions of the operators, and the queries registered on the test tables."""
