"""cadence -- Spark operators and report queries for entity x time x measure
data (hourly counts per station and the like).

Entry points:

* ``cadence.session.build_session`` -- a session with the settings results
  depend on (UTC, AQE), ``profile="cluster"`` for a large cluster;
* ``cadence.sources.files`` -- the hourly export (CSV), landed JSON pages,
  landed Parquet; ``cadence.sources.tables`` -- bindings of the test tables;
* ``cadence.plans.reports`` -- the report tables; ``cadence.plans.bundles`` --
  a report's tables from one scan, written under a run folder;
* ``cadence.streaming.running`` -- the running aggregate as a stream;
* ``python -m cadence <report> ...`` -- the command line.
"""

__version__ = "0.1.0"
