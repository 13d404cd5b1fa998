"""Failure-log classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Rule order and labels of the failure classifier.
# ---------------------------------------------------------------------------
SYNTAX_MARKS = ("IndentationError", "SyntaxError")
MODULE_MARK = "ModuleNotFoundError"
ROLLBACK_MARKS = ("rollback", "AssertionError")  # both must appear
CAPTURE_MARKS = ("capsys", "readouterr", "CaptureResult")
LABEL_SYNTAX = "SyntaxError_Indentation"
LABEL_MODULE = "ModuleNotFoundError"
LABEL_MODULE_ROOT = "ModuleNotFoundError_root_package"
LABEL_ROLLBACK = "AssertionError_rollback"
LABEL_CAPTURE = "AssertionError_capsys"
LABEL_GENERAL = "General_Exception"


def _has(logs: Column, s: str) -> Column:
    return F.instr(logs, s) > 0


def failure_class(logs: Column, root_package: Column | str = "") -> Column:
    """Ordered substring rules; the module rule has a root-package sub-case."""
    root = root_package if isinstance(root_package, Column) else F.lit(root_package)
    syntax = _has(logs, SYNTAX_MARKS[0]) | _has(logs, SYNTAX_MARKS[1])
    module = _has(logs, MODULE_MARK)
    root_hit = (root != "") & (F.instr(logs, root) > 0)
    rollback = _has(logs, ROLLBACK_MARKS[0]) & _has(logs, ROLLBACK_MARKS[1])
    capture = _has(logs, CAPTURE_MARKS[0]) | _has(logs, CAPTURE_MARKS[1]) | _has(logs, CAPTURE_MARKS[2])
    return (
        F.when(syntax, F.lit(LABEL_SYNTAX))
        .when(module & root_hit, F.lit(LABEL_MODULE_ROOT))
        .when(module, F.lit(LABEL_MODULE))
        .when(rollback, F.lit(LABEL_ROLLBACK))
        .when(capture, F.lit(LABEL_CAPTURE))
        .otherwise(F.lit(LABEL_GENERAL))
    )
