"""Plans of the engine: whole evaluations put together from the operators."""
