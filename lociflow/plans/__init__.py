"""Named queries over the test views and the analysis plans built from operators."""
from importlib import import_module

MODULES = ("track_queries", "group_queries", "link_queries", "field_queries", "io_queries")


def load_catalog():
    for name in MODULES:
        import_module(f"lociflow.plans.{name}")
    return import_module("lociflow.plans.catalog")
