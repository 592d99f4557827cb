"""End-to-end jobs composed from operators, and the driver query catalog."""
