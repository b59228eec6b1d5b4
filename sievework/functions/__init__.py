"""Column functions and small frame functions: ranks, metrics, text and scalar rules."""
