import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
FIX = ROOT / "tests" / "fixtures"
SF = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tracefuse.session import get_session
    s = get_session("local[4]", 4)
    yield s


def fixture_path(name: str) -> str:
    return str(FIX / name)


def sf_dir(scale: str) -> str:
    return os.path.join(SF, f"sf{scale}")
