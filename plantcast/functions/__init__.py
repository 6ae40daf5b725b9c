"""Column -> Column helpers: null handling, number text, features and business rules."""
