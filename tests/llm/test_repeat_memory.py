"""What a worker holds at once while it looks for repeats does not grow with its batch."""

import random
import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest

from msgloom.llm import suffix_dedup as S
from tests.conftest import ROOT


def batch(n, size):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(size // 6)) for _ in range(n)]
    wanted = [[{"g": 2 + words, "s": i, "n": 2, "first": 100, "at": 300, "last": 800} for words in (0, 1)] for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts), pa.array(wanted)], ["id", "key", "text", "wanted"])


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("level", [1, 2])
def test_common_grams_go_in_pieces(level, monkeypatch):
    what, given = S.Wanted(400, 51), batch(400, 20_000)
    find = S._finer(what, level)
    assert peak(lambda: [x.num_rows for x in find(iter([given]))]) < 60e6  # of 8 MB of text

    def rows():
        return sorted(str(r) for x in find(iter([given.slice(0, 40)])) for r in x.to_pylist())

    whole = rows()
    monkeypatch.setattr(S, "BATCH_BYTES", 30_000)
    assert rows() == whole and whole


def test_spans_stay_arrays():
    own = pa.array([[{"words": k % 3 == 0, "a": 10 * k, "b": 10 * k + 11 - 2 * (k % 100 == 0)} for k in range(20_000)], None, [], [{"words": False, "a": 5, "b": 9}, {"words": False, "a": 0, "b": 5}, {"words": False, "a": 20, "b": 30}, {"words": False, "a": 21, "b": 22}]] * 10)
    assert peak(lambda: [len(x) for x in S._runs(own, True)]) < 20e6
    got = list(S._runs(own.slice(1, 6)))
    assert got[:2] == [[], []] and got[2] == [(0, 9), (20, 30)]
    runs = []
    for k in (k for k in range(20_000) if k % 3):  # touching and apart
        a, b = 10 * k, 10 * k + 11 - 2 * (k % 100 == 0)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    assert got[3] == [tuple(x) for x in runs]


def test_workers_give_memory_back():
    code = """
import numpy as np, pyarrow as pa, psutil
from msgloom.llm._io import lean
held = []
def task(batches):
    for batch in batches:
        many = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in pieces
        held.append(np.ones(1_000))  # stays, behind them
        del many
        yield batch
rss = lambda: psutil.Process().memory_info().rss
run, before = lean(task), rss()
for _ in run(iter([pa.record_batch({'x': pa.array([1])})])): pass
assert rss() - before < 60e6, (rss() - before) / 1e6
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
