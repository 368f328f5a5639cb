"""Whole plans: scanning repositories, reports, the command line, and the registered queries."""
