"""One very long text: what each operator's scan of it holds at its peak, measured in a process of its own."""

import os
import resource
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: MB of memory per MB of text, at most, beyond what an idle process has.
MOST = 60


def long_text(mb):
    words = [f"word{i % 977}x{i * i % 7919}" for i in range(100_000)]
    out, size = [], 0
    while size < mb << 20:
        out.append(" ".join(words) + "\n" + "y" * 2000)
        size += len(out[-1])
    return "".join(out)[: mb << 20]


def quality(text, pa):
    from sluice.llm import quality_rules, scan

    raw, offsets = scan.text_bytes(pa.array([text]))
    assert quality_rules._statistics(raw, offsets)["n_words"][0] > 0


def suffix(text, pa):
    from sluice.llm import suffix_dedup

    assert suffix_dedup.Entries(pa.table({"doc_id": [1], "text": [text]}), 8).pieces.windows.sum() == len(text) - 49


def toxicity(text, pa):
    from sluice.llm import toxicity

    assert len(toxicity.Grams([text]).bucket)


def jaccard(text, pa):
    from sluice.llm import jaccard_join

    assert jaccard_join.set_columns(pa.table({"text": [text]}))["n"][0].as_py() > 0


def index(text, pa):
    import numpy as np

    from sluice.llm import decontaminate

    h = decontaminate._words(text)
    assert len(np.argsort(h, kind="stable")) == len(h) > 0


def tokens(text, pa):
    import public_tokenizers

    from sluice.llm import packing, tokens

    assert len(tokens.Encoder(public_tokenizers.path(packing.VOCABULARY)).encode(pa.array([text]))[0])


SCANS = {f.__name__: f for f in (quality, suffix, toxicity, jaccard, index, tokens)}


def peak(name, mb):
    """MB that the scan adds to an idle process."""
    out = subprocess.run([sys.executable, os.path.abspath(__file__), name, str(mb)], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT}, check=True)
    return float(out.stdout)


@pytest.mark.parametrize("name", SCANS)
def test_memory_of_a_long_text(name):
    assert peak(name, 8) < MOST * 8


if __name__ == "__main__":
    import pyarrow

    used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    source = long_text(int(sys.argv[2]))
    before = used()
    SCANS[sys.argv[1]](source, pyarrow)
    print(used() - before)
