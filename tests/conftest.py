import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def pair_sign_sum_bruteforce(a) -> int:
    """W3 pair by pair."""
    a = np.asarray(a, dtype=np.int64)
    return sum(int(np.sign(a[i] - a[i + 1:]).sum()) for i in range(len(a) - 1))


@pytest.fixture(scope="session")
def spark():
    from tasklens.session import ensure_checkpoint_dir, local_session
    s = local_session(cores=8, shuffle_partitions=8, app_name="tasklens-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    sys.path.insert(0, os.path.join(ROOT, "scripts"))
    from check_oracle import duck
    return duck(SF_SMALL)
