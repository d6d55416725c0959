"""Sources and sinks: base tables, fixture adapters, CSV ingest, catalog."""

from dinelens.sources.driver import BaseTables
from dinelens.sources import fixtures

__all__ = ["BaseTables", "fixtures"]
