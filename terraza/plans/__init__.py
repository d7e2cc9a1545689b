"""Registered queries: importing this package fills the registry."""

from terraza.plans import answers, cases, checks, entities, evidence, files, geo, history, identity, listings, marketfacts, measures, orders, polygons, records, scenario, text, timeline, views  # noqa: F401
