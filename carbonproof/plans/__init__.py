"""Copy plans, preflight checks and copy jobs."""
