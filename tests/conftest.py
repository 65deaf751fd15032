import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from leakscope.session import local_session

    session = local_session(
        "leakscope-tests",
        "8",
        **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"},
    )
    yield session
    session.stop()
