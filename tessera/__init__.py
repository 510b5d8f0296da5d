"""tessera: tabular preparation and modelling as Spark jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
statistics result computed by a Spark aggregate).  Nothing large is
collected to the driver: only per-column statistics, bin edges, label sets
and model coefficients, all bounded by the number of columns / classes /
bins, never by the number of rows.
"""

from tessera.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
