"""DataFrame-to-DataFrame operators, grouped by stage."""
