"""Results survive task failures: first attempts of many tasks fail and
are retried (master local[4,3]); the output equals a run without failures
(counter-based randomness, one set of range bounds per numbering)."""

import json
import os
import subprocess
import sys

from conftest import SF_SMALL

APP = os.path.join(os.path.dirname(os.path.abspath(__file__)), "apps", "retry_app.py")


def _run(inject: bool, marks: str | None = None) -> dict:
    env = dict(os.environ, **({"RETRY_MARKS": marks} if marks else {}))
    res = subprocess.run([sys.executable, APP, SF_SMALL, "1" if inject else "0"], check=True,
                         capture_output=True, text=True, timeout=900, env=env)
    line = [ln for ln in res.stdout.splitlines() if ln.startswith("RESULT ")][-1]
    return json.loads(line[len("RESULT "):])


def test_results_equal_with_retried_failures(tmp_path):
    clean, retried = _run(False), _run(True, str(tmp_path))
    assert len(os.listdir(tmp_path)) >= 8        # failures really happened and were retried
    assert set(clean) == {"keyed", "rownum", "fifo", "w3"}
    for k in clean:
        assert clean[k] == retried[k], k
    assert len(clean["rownum"]) == 6000 and len(clean["keyed"]) == 1500
