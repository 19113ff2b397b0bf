"""Fields from tables, and fitted models on shared storage."""
