import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sitewise.session import local_session
    # the only place that makes a scratch folder: a local session of one machine
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    s = local_session("*", 8, app="sitewise-tests", extra={"spark.checkpoint.dir": folder})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as sorted tuples."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, x) for x in t))
