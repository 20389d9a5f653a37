import numpy as np
import pyarrow as pa

from snapweave.llm import substrings


def test_one_pass_gives_pieces_and_ranges():
    """Repeated ranges are found in the pass that finds the pieces, and pass by the comparison."""
    text = " ".join(f"word{i * i}" for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, "x", text])], names=["d", "text"])
    out = pa.Table.from_batches(substrings._pieces(np.zeros(0, np.int64), 4, [batch])).to_pylist()
    ranges = [r for r in out if r["share"] < 0]
    assert [(r["anchor"], r["d"], r["at"], r["piece"]) for r in ranges] == [(3, 3, 0, len(text))]
    rows = sorted(out, key=lambda r: tuple(r.values()))
    passed = pa.Table.from_batches(substrings._compare(1000, pa.Table.from_pylist(rows, pa.schema([("anchor", pa.int64()), ("share", pa.int32()), ("piece", pa.int64()), ("d", pa.int64()), ("t", pa.int32()), ("at", pa.int64())])).to_batches())).to_pylist()
    assert [(r["d"], r["at"], r["anchor"]) for r in passed if r["salt"] == -1] == [(3, 0, len(text))]
    own, start, end = substrings._runs_of(np.array([0, 0, 0, 1]), np.array([0, 5, 30, 40]), np.array([20, 10, 40, 50]))
    assert list(zip(own.tolist(), start.tolist(), end.tolist())) == [(0, 0, 20), (0, 30, 40), (1, 40, 50)]
