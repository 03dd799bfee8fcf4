"""Built-in functions: column forms for queries, driver-side forms for values."""
