"""Adapter views over the driver tables, the query catalogue and its SQL oracle."""
