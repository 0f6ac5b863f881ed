"""Operators on reads: derivation, counting profiles and what is derived from them."""
