"""Contract, planning and the governed write path."""
