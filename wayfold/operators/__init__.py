"""DataFrame-to-DataFrame operators, grouped by the kind of table they produce."""
