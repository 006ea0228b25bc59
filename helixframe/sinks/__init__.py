"""Writers of the engine."""
