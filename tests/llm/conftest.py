import pytest


@pytest.fixture(scope="session")
def ranks(spark):
    from prismveil.llm.queries import tokenizer

    return tokenizer(spark)
