"""The rest works where the training-data operators or a library of theirs are absent."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_a_library():
    code = "import sys; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'score_ma' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=300)
