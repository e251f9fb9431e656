"""Event-time windows and stateful operators, for batch tables and streams alike."""
