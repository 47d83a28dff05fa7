import pytest

from vicinage.plans.views import Tables
from vicinage.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="8g")
    yield session
    session.stop()


@pytest.fixture()
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture()
def ask(spark):
    """Evaluate one Column over a list of texts (or tuples) and give the answers in order."""
    from pyspark.sql import functions as F

    def run(rows, schema, column):
        df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r["v"] for r in df.select("_i", column.alias("v")).orderBy("_i").collect()]
    return run
