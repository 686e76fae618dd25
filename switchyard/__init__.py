"""switchyard: support-routing analytics as PySpark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``); nothing collects rows to the driver.
"""

from switchyard.policy import Policy

__all__ = ["Policy"]
__version__ = "0.1.0"
