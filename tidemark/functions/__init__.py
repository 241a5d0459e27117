"""Column-level helpers: no job is started here."""
