"""Registered query plans and the SQL that checks them."""
