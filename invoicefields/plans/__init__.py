"""Registered queries: Spark on one side, check SQL on the other."""
