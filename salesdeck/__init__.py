"""salesdeck — retail sales analytics as Spark DataFrame plans.

Layout:
  sources/    readers, canonical schema, adapter views, date parsing, catalog
  functions/  column expressions: money in cents, measures, labels, tiers
  operators/  reusable plan fragments: bounded broadcast, distributed ranking,
              top-k / paging
  plans/      the analyses ("marts"), one function per result DataFrame
  sinks/      row and document writers

Every analysis is ``f(star, params) -> DataFrame``: lazy, no collect, no UDF,
no session creation.
"""

from salesdeck.api import dormant, filter_segment, segment
from salesdeck.params import DEFAULT, REFERENCE, Params
from salesdeck.sources.star import Star, load_canonical, load_star

__all__ = ["DEFAULT", "REFERENCE", "Params", "Star", "load_star", "load_canonical",
           "segment", "dormant", "filter_segment"]
