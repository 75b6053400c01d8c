"""Column functions: everything a text or vector operator computes from one row."""
