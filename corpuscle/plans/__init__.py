"""Registered queries over the driver's tables, with SQL to hold them against."""
