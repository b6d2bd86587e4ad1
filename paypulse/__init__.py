"""paypulse: monitoring of order and payment events on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function, so the same code
runs in batch jobs, inside ``foreachBatch`` and in the driver contract.
"""

from paypulse.plans.monitor import PaymentMonitor
from paypulse.session import build_session

__all__ = ["PaymentMonitor", "build_session"]
