"""Column functions: everything here builds expressions and touches no data."""
