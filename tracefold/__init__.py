"""tracefold: Spark-native analytics over command-execution traces.

Operators are plain functions from DataFrames (or Columns) to DataFrames
(or Columns).  Everything that can be a Catalyst expression is one; the
few Python pieces (indel similarity, unified diff, greedy sub-word
encoding, stateful streaming) run as Arrow-batched pandas functions.
"""

from tracefold.session import get_spark, checkpoint_dir, scratch_path  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "scratch_path"]
