"""Column helpers and ordered scans used by the operators."""
