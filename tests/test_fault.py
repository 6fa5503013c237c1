import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_idx_writer_survives_task_retry():
    """A task fails after writing some of its files; the retry rewrites them."""
    r = subprocess.run([sys.executable, os.path.join(HERE, "jobs", "retry_idx.py")],
                       capture_output=True, text=True, timeout=600)
    assert "RETRY-OK" in r.stdout, r.stdout[-2000:] + r.stderr[-4000:]
