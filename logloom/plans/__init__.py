"""Query plans and their reference SQL."""
