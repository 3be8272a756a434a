import pytest

from glyphmill.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    spark = session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"{shared}/warehouse", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
