"""Plan helpers: sessions, table loading and lineage cuts."""
