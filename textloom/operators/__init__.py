"""Relational operators: index build, ranking, correction, completion."""
