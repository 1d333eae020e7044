"""Package of the library; see the modules."""
