"""Fitted models over unbounded rows."""
