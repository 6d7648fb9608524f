"""The driver's contract: the entry is imported before there is a session."""

import os
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_session():
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; print('fine')"
    run = subprocess.run([sys.executable, "-c", said], cwd=HOME, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("fine"), run.stderr[-500:]
