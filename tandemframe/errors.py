"""Errors of the engine. The command line ends with status 2 on any of them."""


class TandemError(Exception):
    """Root of the hierarchy."""


class SourceError(TandemError):
    """An input can't be read or fails validation."""


class PanelError(TandemError):
    """A panel, catalog or range table is inconsistent."""


class EvidenceError(TandemError):
    """Reads can't be turned into observations."""


class InterpretationError(TandemError):
    """Evidence can't be turned into calls."""


class ReportError(TandemError):
    """A sink can't be written."""


class ParameterError(TandemError):
    """A threshold has a value it can't have."""
