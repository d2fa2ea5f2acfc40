"""Column expressions on integers and bits, and the coder's fixed tables."""
