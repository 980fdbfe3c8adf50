import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agentmetrics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *sort):
    """Rows as dicts, sorted by the named columns."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in sort)) if sort else out


@pytest.fixture
def write_log(tmp_path):
    """Write records (dicts, or raw text for a broken line) to one log file."""
    def write(relative, records):
        target = tmp_path / relative
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("".join(
            (r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
        return str(tmp_path / relative.split("/")[0])
    return write
