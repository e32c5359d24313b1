"""Operators composed into the phases of an evaluation, and the registered queries."""
