"""The engine's facade, and the registered queries."""
