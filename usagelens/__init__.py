"""usagelens: usage-telemetry analytics for AI coding assistants on Spark.

Every analytic is a function ``(Tables, Filters, ...) -> DataFrame`` built
from built-in Spark SQL expressions; ingest is a batch transform that the
Structured Streaming jobs reuse unchanged.
"""

from usagelens.params import Filters, PlanConfig, Tables
from usagelens.session import configure, get_session

__all__ = ["Filters", "PlanConfig", "Tables", "configure", "get_session"]
