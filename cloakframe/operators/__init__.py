"""Relational operators: maps, anonymization, restore, policy gate, inspection, scrub and registry."""
