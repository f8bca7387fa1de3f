"""Redaction rule sets. They differ on purpose: each store keeps its own patterns and marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marks of the rule sets, in the order in which they apply.
LOG_RULES = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"(?i)\b([A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*)\s*=\s*[^,\s;]+", "$1=[redacted]"),
    (r'\b[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\s\r\n]*', "[local-path]"),
)
#: Folders at the root whose paths are local ones; a deployment adds its own.
LOCAL_ROOTS = ("Users", "home", "tmp", "var", "private", "mnt")
SECRET_RULES = (
    (r"sk-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]{10,}", "Bearer [REDACTED]"),
    (r"(?i)\b(api[_-]?key|apikey|access[_-]?token|secret|password)(\s*[:=]\s*)(\S+)", "$1$2[REDACTED]"),
)
CAPTURE_RULES = (
    (r"(?i)(api[_-]?key|x-api-key)(\s*[:=]\s*)([A-Za-z0-9_\-]{8,})", "$1$2[REDACTED]"),
    (r"(?i)(authorization|bearer)(\s*[:=]?\s*)(Bearer\s+)?([A-Za-z0-9._\-]{8,})", "$1$2[REDACTED]"),
    (r"[A-Za-z]:\\[^\s\"']+", "[REDACTED_LOCAL_PATH]"),
    (r"(?<![\w.])/(?:Users|home|var|tmp|mnt)/[^\s\"']+", "[REDACTED_LOCAL_PATH]"),
)
FILE_RULES = CAPTURE_RULES[2:]
FIXTURE_RULES = (
    (r"(?i)\b[A-Z]:[\\/][^\s\r\n\"'<>|?*]+", "[REDACTED_PATH]"),
    (r"\\\\[^\\/\s]+[\\/][^\s\r\n\"'<>|?*]+", "[REDACTED_PATH]"),
    (r"(?<![\w:])/(?:Users|home|tmp|var|mnt|opt|private|Volumes)/[^\s\r\n\"']+", "[REDACTED_PATH]"),
)
WHOLE_PATH = r"(?i)^(?:[A-Z]:[\\/].+|\\\\[^\\/]+[\\/].+|/(?:Users|home|tmp|var|mnt|opt|private|Volumes)/.+)"
SECRET_NAMES, SECRET_PARTS = ("token", "access_token", "refresh_token", "auth_token", "bearer_token"), "api_key|authorization|secret|password"
LONG_TEXT = "[redacted-long-text]"
SENSITIVE_KEYS = "api_key|apikey|authorization|bearer|password|secret|token"


def _apply(text: Column, rules) -> Column:
    for pattern, mark in rules:
        text = F.regexp_replace(text, pattern, mark)
    return text


def for_log(text: Column, longest: int = 240, roots: tuple[str, ...] = LOCAL_ROOTS) -> Column:
    """Secrets and local paths masked; longer results replaced as a whole."""
    masked = _apply(text, (*LOG_RULES, (rf"(?<!\w)/(?:{'|'.join(roots)})(?:/[^\s,;]+)+", "[local-path]")))
    return F.when(F.length(masked) > longest, F.lit(LONG_TEXT)).otherwise(masked)


def secrets(text: Column) -> Column:
    """Credentials masked, the rest as it is."""
    return _apply(text, SECRET_RULES)


def fields_for_log(fields: Column, longest: int = 240) -> Column:
    """A string map: values under sensitive keys masked, others redacted as text."""
    hidden = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).rlike(SENSITIVE_KEYS)
    return F.transform_values(fields, lambda k, v: F.when(hidden(k), F.lit("[redacted]")).otherwise(for_log(v, longest)))


def _shortened(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("...[TRUNCATED]"))).otherwise(text)


def for_capture(text: Column, longest: int) -> Column:
    """A captured search: keys, bearers and local paths masked, long texts cut and marked."""
    return _shortened(_apply(text, CAPTURE_RULES), longest)


def file_paths(text: Column) -> Column:
    """Messages of file readers: local paths masked."""
    return _apply(text, FILE_RULES)


def for_fixture(text: Column, longest: int | None = None) -> Column:
    """A recorded request or answer: a text with a bearer goes whole, a text that is a path too, paths inside are masked."""
    stripped = F.trim(text)
    masked = F.when(stripped.rlike(WHOLE_PATH), F.replace(text, stripped, F.lit("[REDACTED_PATH]"))).otherwise(_apply(text, FIXTURE_RULES))
    safe = F.when(F.contains(text, F.lit("Bearer ")), F.lit("Bearer [REDACTED]")).otherwise(masked)
    return safe if longest is None else F.when(F.length(text) > longest, _shortened(text, longest)).otherwise(safe)


def fields_for_fixture(fields: Column, longest: int | None = None) -> Column:
    """A string map of a recorded request: values under secret names masked, others redacted as text."""
    hidden = lambda k: F.lower(k).isin(*SECRET_NAMES) | F.lower(k).rlike(SECRET_PARTS)
    return F.transform_values(fields, lambda k, v: F.when(hidden(k), F.lit("[REDACTED]")).otherwise(for_fixture(v, longest)))
