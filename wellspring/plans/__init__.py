"""Runnable queries over the given tables, each with its SQL counterpart."""
