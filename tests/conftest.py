import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T

from sightline.runtime import local_session, ship


def exact(value, kind):
    """A test value as its column's type wants it, so that 1 may stand for 1.0."""
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [exact(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        values = value.values() if isinstance(value, dict) else value
        return tuple(exact(v, f.dataType) for v, f in zip(values, kind.fields, strict=True))
    return value


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, spark__sql__shuffle__partitions="4")
    ship(session)
    plain = session.createDataFrame

    def create(data, schema):
        kind = T.StructType.fromDDL(schema)
        if hasattr(data, "columns"):  # the library's own frames are typed already
            return plain(data, kind)
        return plain([exact(r, kind) for r in data], kind)

    session.createDataFrame = create
    yield session
    del session.createDataFrame
    session.stop()
