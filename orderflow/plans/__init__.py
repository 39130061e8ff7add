"""Query catalogue, its SQL equivalents and rendered order documents."""
