"""Header and item extraction per document layout, as column expressions."""
