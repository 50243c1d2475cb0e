"""Registered queries and their SQL restatements."""
