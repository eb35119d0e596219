from __future__ import annotations

import pytest

from corkscrew.llm.spark import tune
from corkscrew.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[4]", partitions=4)
    tune(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
