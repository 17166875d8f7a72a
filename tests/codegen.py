"""Generated code on or off for the frames of a test module."""

from __future__ import annotations


def generated_code(session, on: bool) -> None:
    """Compiling code costs more than it saves on frames of a few rows; the query tests turn it on."""
    session.conf.set("spark.sql.codegen.wholeStage", str(on).lower())
    session.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if on else "NO_CODEGEN")
