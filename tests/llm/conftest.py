import duckdb
import pytest


@pytest.fixture()
def duck():
    con = duckdb.connect()
    yield con
    con.close()
