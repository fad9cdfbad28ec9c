import pytest


@pytest.fixture(scope="session")
def q():
    import __spark_entry__ as e

    return e.queries()
