"""functions of the engine; see the README for the inventory."""
