"""Sources and sinks: typed CSV/parquet loaders, driver-table fixtures, views."""

from arrears.sources.fixtures import Inputs, inputs

__all__ = ["Inputs", "inputs"]
