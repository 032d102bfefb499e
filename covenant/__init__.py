"""covenant: contract / event / ledger analytics as plain Spark DataFrame operators.

Every public operator is a pure function DataFrame(s) -> DataFrame. Nothing is
collected to the driver; the plan is left to Catalyst and AQE.
"""

from covenant.sources.binding import Tables, load_tables

__all__ = ["Tables", "load_tables"]
