"""Readers: raw test tables, canonical tables, adapter views, date parsing."""
