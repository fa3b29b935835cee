"""Edge weights and how they adapt to a project's profile."""

from __future__ import annotations

# Edge weights by type, plain and for adaptive walks; unknown types weigh 0.5.
BASE = {"CALLS": 1.0, "USES": 0.8, "CONTAINS": 0.3, "EXTENDS": 0.6, "IMPLEMENTS": 0.6, "RETURNS": 0.4, "PARAMETER": 0.4}
ADAPTIVE = {"CALLS": 1.3, "USES": 1.0, "CONTAINS": 0.4, "EXTENDS": 0.7, "IMPLEMENTS": 0.7, "RETURNS": 0.5, "PARAMETER": 0.5, "THROWS": 0.6, "ANNOTATED": 0.8, "OVERRIDES": 0.9, "DEPENDS_ON": 0.6}
UNKNOWN = 0.5
# Factors by project type.
FACTORS = {
    "gui_application": {"USES": 1.3, "CONTAINS": 1.4, "ANNOTATED": 1.2},
    "framework_library": {"EXTENDS": 1.6, "IMPLEMENTS": 1.5, "RETURNS": 1.3, "ANNOTATED": 1.3, "OVERRIDES": 1.4},
    "data_processing": {"CALLS": 1.4, "PARAMETER": 1.3, "THROWS": 1.2, "DEPENDS_ON": 1.2},
    "utility_library": {"CALLS": 0.9, "USES": 1.2, "RETURNS": 1.1},
    "business_logic": {"CALLS": 1.2, "USES": 1.2, "THROWS": 1.1, "DEPENDS_ON": 1.1},
    "large_enterprise": {"CALLS": 2.0, "USES": 1.8, "CONTAINS": 0.3, "EXTENDS": 1.5, "IMPLEMENTS": 1.5, "RETURNS": 1.4, "PARAMETER": 1.4, "THROWS": 1.3, "ANNOTATED": 1.3, "OVERRIDES": 1.4, "DEPENDS_ON": 1.3},
    "general": {},
}
SCALE = 10_000


def adapted(project_type: str, average_complexity: float, methods: int) -> dict[str, float]:
    """The adaptive weights of a project. An unknown project has averages 0."""
    factors = dict(FACTORS.get(project_type, {}))
    changes = []
    if average_complexity > 4:
        changes.append({"CALLS": 1.3, "DEPENDS_ON": 1.2, "THROWS": 1.1})
    elif average_complexity < 2:
        changes.append({"CALLS": 0.9, "USES": 1.1})
    if methods > 100:
        changes.append({"CONTAINS": 1.2, "EXTENDS": 1.1, "IMPLEMENTS": 1.1})
    elif methods < 20:
        changes.append({"CALLS": 1.2, "USES": 1.1})
    out = {k: w * factors.get(k, 1.0) for k, w in ADAPTIVE.items()}
    for change in changes:
        out |= {k: out[k] * f for k, f in change.items()}
    return {k: round(w, 4) for k, w in out.items()}
