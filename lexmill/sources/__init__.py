"""Table readers, JSON Lines exchange and idempotent table writes."""
