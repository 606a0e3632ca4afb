"""The analyses.  Each is ``f(star, params=DEFAULT) -> DataFrame``."""
