"""Registered queries over the test tables, each with the SQL it must agree with.

A module maps a query name to (function of session and folder, SQL text or None).
"""
