"""Registered plans: the queries run on the driver tables and their SQL oracles."""
