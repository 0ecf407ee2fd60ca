"""End-to-end flows and the registered queries over the driver tables."""
