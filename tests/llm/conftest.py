import importlib

import pytest

from barloom.llm.common import ship


@pytest.fixture(scope="session")
def llm_spark(spark):
    return ship(spark)


@pytest.fixture
def low(llm_spark, monkeypatch):
    """Sets constants of a module, here and in the Python workers."""

    def put(module, **values):
        name, kind = module.__name__, type(llm_spark.range(1))
        real = kind.mapInArrow
        for k, v in values.items():
            monkeypatch.setattr(module, k, v)

        def map_in_arrow(self, func, schema, *args, **more):
            def run(batches):
                there = importlib.import_module(name)
                old = {k: getattr(there, k) for k in values}
                there.__dict__.update(values)
                try:
                    yield from func(batches)
                finally:
                    there.__dict__.update(old)

            return real(self, run, schema, *args, **more)

        monkeypatch.setattr(kind, "mapInArrow", map_in_arrow)

    return put
