"""Operators: detection rules on facts, and the algebra of findings."""
