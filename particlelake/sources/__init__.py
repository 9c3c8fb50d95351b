"""Readers and writers for records, feature tables, stations and reports."""
