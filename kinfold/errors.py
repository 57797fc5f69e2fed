"""Errors of the library, limits, and checks of configurations (driver side, before any job)."""

from __future__ import annotations

from kinfold.types import ACTIONS, STRATEGIES


class KinfoldError(Exception):
    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details


class FileProcessingError(KinfoldError):
    pass


class DataValidationError(KinfoldError):
    pass


class ConfigurationError(KinfoldError):
    pass


class ProcessingError(KinfoldError):
    pass


class OutOfMemory(KinfoldError):
    pass


class ResolutionError(KinfoldError):
    pass


#: What a user is told, by kind of error.
ADVICE = {
    FileProcessingError: "The file could not be read: check its path, format and encoding.",
    DataValidationError: "The data did not pass validation: check columns and values.",
    ConfigurationError: "The configuration is not valid: check the named settings.",
    OutOfMemory: "The job ran out of memory: use more partitions or larger executors.",
    ResolutionError: "A decision could not be applied: check its group and its selected records.",
    ProcessingError: "Processing failed.",
}
#: Spark's own error classes, by prefix.
_SPARK = (
    ("PATH_NOT_FOUND", FileProcessingError),
    ("FAILED_READ_FILE", FileProcessingError),
    ("UNABLE_TO_INFER_SCHEMA", FileProcessingError),
    ("UNRESOLVED_COLUMN", DataValidationError),
    ("CAST_INVALID_INPUT", DataValidationError),
    ("UNABLE_TO_ACQUIRE_MEMORY", OutOfMemory),
)


class ErrorHandler:
    """Counts errors and turns them into the library's kinds with advice."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def handle(self, error: Exception, **details) -> KinfoldError:
        name = error.getCondition() if hasattr(error, "getCondition") else None
        kind = next((k for prefix, k in _SPARK if name and name.startswith(prefix)), None)
        if kind is None:
            kind = type(error) if isinstance(error, KinfoldError) else OutOfMemory if isinstance(error, MemoryError) else FileProcessingError if isinstance(error, OSError) else ProcessingError
        self.counts[kind.__name__] = self.counts.get(kind.__name__, 0) + 1
        return error if isinstance(error, kind) else kind(str(error), cause=type(error).__name__, **details)

    def advice(self, error: KinfoldError) -> str:
        return next((text for kind, text in ADVICE.items() if isinstance(error, kind)), str(error))

    def limit(self, what: str, value: float, most: float) -> str | None:
        """A message if a limit of memory (MB), time (seconds) or records is passed."""
        return f"{what} is {value:g}, above the limit of {most:g}" if value > most else None

    def summary(self) -> dict[str, int]:
        return dict(self.counts)

    def reset(self) -> None:
        self.counts.clear()


def validate_configuration(config: dict) -> list[str]:
    """What is wrong with a configuration {matching, resolution, performance}; empty if nothing is."""
    wrong = []
    matching, resolution, performance = (config.get(k, {}) for k in ("matching", "resolution", "performance"))
    mode = matching.get("mode", "exact")
    if mode not in ("exact", "fuzzy", "both"):
        wrong.append(f"matching.mode: {mode!r} is not exact, fuzzy or both")
    fields = matching.get("fields")
    if not isinstance(fields, list) or not fields:
        wrong.append("matching.fields: a list of at least one field is needed")
    if mode in ("fuzzy", "both"):
        threshold = matching.get("fuzzy_threshold")
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 100:
            wrong.append("matching.fuzzy_threshold: a number from 0 to 100 is needed")
    if (action := resolution.get("default_action", "FLAG")) not in ACTIONS:
        wrong.append(f"resolution.default_action: {action!r} is not one of {', '.join(ACTIONS)}")
    if (strategy := resolution.get("merge_strategy", "most_complete")) not in (*STRATEGIES, "first_record"):
        wrong.append(f"resolution.merge_strategy: {strategy!r} is not one of {', '.join(STRATEGIES)}")
    memory = performance.get("memory_limit_mb", 1)
    if isinstance(memory, bool) or not isinstance(memory, (int, float)) or memory <= 0:
        wrong.append("performance.memory_limit_mb: a positive number is needed")
    batch = performance.get("batch_size", 1)
    if isinstance(batch, bool) or not isinstance(batch, int) or batch <= 0:
        wrong.append("performance.batch_size: a positive whole number is needed")
    return wrong
