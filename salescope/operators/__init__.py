"""DataFrame operators over the canonical sales schema."""
