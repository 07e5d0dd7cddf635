"""Registered queries over the given tables, each beside the SQL that must agree with it."""
import importlib

MODULES = ("scoring", "geometry", "evidence", "nearby", "names", "clipped", "runs", "ingest", "facts", "reports")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"lodegrid.catalog.{name}")
