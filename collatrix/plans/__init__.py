"""Query plans of the driver catalogue."""
