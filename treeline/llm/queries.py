"""All registered queries of this package."""

from __future__ import annotations

from treeline.llm import functions, language, leakage, mixing, origin, syntax  # noqa: F401
from treeline.llm.common import ORACLES, QUERIES  # noqa: F401
