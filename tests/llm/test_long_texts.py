"""Memory of texts of 20 MB without a space, outside Spark, each in a process of its own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
START = """
import resource, sys
import numpy as np, pyarrow as pa
np.seterr(over="ignore")
text = pa.array(["y" * 10_000_000 + "é-z!" * 2_500_000, "short text"], pa.string())
rows = lambda: iter([pa.record_batch([pa.array([1, 2]), text, pa.array([1, 2]), pa.array([1, 2])], names=list("abcd"))])
"""
CASES = {
    "words": "from pertlake.llm import ngram_join as m\nassert [len(s) for _, sets in m._sets(rows()) for s in sets] == [1, 1]",
    "statistics": "from pertlake.llm import quality as m\nassert m.statistics(text).shape[0] == 2",
    "toxicity": "from pertlake.llm import toxicity as m\nassert m.Model(np.zeros(m.CODES, np.float32), 0.0, (0.0, 0.0, 0.0, 0.0)).score(text).shape == (2,)",
    "minimizers": "from pertlake.llm.text_hash import iter_documents\nassert [len(w.hashes) for _, w, _, _ in iter_documents(rows(), False)] == [1, 2]",
}


@pytest.mark.parametrize("case", CASES)
def test_memory_of_a_text_without_spaces(case):
    end = "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", START + CASES[case] + end], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 2000
