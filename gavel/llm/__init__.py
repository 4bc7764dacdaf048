"""Training-data operators: tokenising, scoring, de-duplicating, cleaning and packing documents."""
