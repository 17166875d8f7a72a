from __future__ import annotations

import pytest

SETTINGS = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Generated code on, as in production, for the tests here."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
