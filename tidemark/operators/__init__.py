"""DataFrame operators: change handling, cleaning, star schema, quality."""
