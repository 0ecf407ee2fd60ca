"""tracefuse: container threat-detection analytics as lazy Spark DataFrame operators.

Syscall events and decoded packet rows become fixed-schema feature tables,
per-signal scores are paired through a bridge table and fused with an
explainable threshold rule, and detection quality is reported with exact,
skew-safe aggregations.  Every operator is ``DataFrame -> DataFrame``.
"""

__version__ = "0.1.0"
