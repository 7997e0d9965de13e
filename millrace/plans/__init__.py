"""Tasks compiled to DataFrame plans."""
