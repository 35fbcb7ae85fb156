"""postingscope: Spark-native hiring-transparency analytics.

A library of DataFrame operators (``functions`` are Column -> Column,
``operators`` are DataFrame -> DataFrame), the sources/sinks that feed
them, composite batch jobs in ``plans`` and Structured Streaming jobs in
``streaming``.  Every lexicon, weight, threshold and reference time is a
parameter; nothing reads the wall clock.
"""

from postingscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
