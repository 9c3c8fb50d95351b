"""Whole analyses, table stand-ins and the query registry."""
