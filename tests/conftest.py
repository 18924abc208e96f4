import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from filigree.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = local_session(4, "3g", 4)
    ship(found)
    yield found
    found.stop()
