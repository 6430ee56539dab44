import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.llm.common import Scratch  # noqa: E402


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as made:
        yield made
