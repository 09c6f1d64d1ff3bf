"""The checks and read-side operators, each a DataFrame in and out."""
