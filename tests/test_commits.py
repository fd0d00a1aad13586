import pyarrow as pa

from quern.sources import notes


def test_blocks_that_share_a_batch_keep_their_commits():
    """Lines of several files in one batch: those after the first are slices of it."""
    lines = [x for f in range(3) for c in range(40) for x in (f"{f:08d}{c:032x}", *[f":100644 100644 {'0' * 40} {n:040x} M\tp{n}.md" for n in range(c % 5)])]
    want = [(str(f), f"{f:08d}{c:032x}") for f in range(3) for c in range(40) for _ in range(c % 5)]
    of = [str(f) for f in range(3) for _ in range(len(lines) // 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(of), pa.array([0] * len(lines), pa.int64())], ["value", "file_path", "file_block_start"])
    got = pa.Table.from_batches(list(notes._with_commits(iter([batch]))))
    got.validate(full=True)
    assert [(r["f"], r["commit_sha"]) for r in got.to_pylist() if r["line"] is not None] == want
