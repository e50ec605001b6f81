"""Part of the event log engine."""
