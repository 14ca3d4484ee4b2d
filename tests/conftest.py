import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skydrift.runtime import session

    s = session("4", 4, "4g")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    return s


@pytest.fixture(scope="session")
def rows():
    def collect(df, *cols):
        return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)

    return collect
