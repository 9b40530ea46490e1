"""Classed errors: callers catch what they can act on."""


class TidemarkError(ValueError):
    """Any refusal of the engine."""


class InvalidBars(TidemarkError):
    """Bars that break the schema, the OHLC bounds, whole seconds or uniqueness."""


class CoverageError(TidemarkError):
    """An instrument without a bar at some pulse, or not in the snapshot at all."""


class SnapshotError(TidemarkError):
    """A snapshot in a state that doesn't allow the call."""


class InvalidTarget(TidemarkError):
    """A strategy result that isn't a full finite target vector."""


class InvalidConfig(TidemarkError):
    """Arguments that can't make an experiment, a grid, a cost or a risk chain."""


class InvalidFeature(TidemarkError):
    """Values of an indicator that aren't finite after warm-up, or too few of them."""


class UnknownFeature(TidemarkError):
    """A feature id or alias that the run doesn't have."""


class PreflightError(TidemarkError):
    """A strategy that can't be run again with the same result."""


class ValidationError(TidemarkError):
    """Return panels on which a statistic isn't defined."""
