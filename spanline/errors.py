"""Errors of the interval merge."""


class MergeError(RuntimeError):
    """Base of all merge errors."""


class InvalidJoinConfigurationError(MergeError):
    """Join keys are not a list of names."""


class InvalidDataFrameError(MergeError, TypeError):
    """An input is no DataFrame, or lacks columns."""


class InvalidSegmentError(MergeError):
    """A segment's bounds are wrong."""


class ZeroLengthSegmentError(InvalidSegmentError):
    """A segment starts where it ends."""


class DuplicateLabelError(MergeError):
    """A column name stands twice."""


class OutputCollisionError(MergeError):
    """An output column is in the target already."""


class InvalidAggregationError(MergeError, TypeError):
    """A numeric aggregation was asked for on another type."""


class PercentileConfigurationError(MergeError, ValueError):
    """A percentile is outside 0 to 1."""
