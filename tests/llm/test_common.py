import subprocess
import sys

#: A worker that reads batches of 32 MB as Spark sends them; what it holds of freed memory afterwards, in MB.
WORKER = """
import re
import numpy as np, pyarrow as pa
from tallyweave.llm.common import grouped_by_bytes

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def batches():
    for k in range(4):
        yield pa.RecordBatch.from_arrays([pa.array([f"{k}{n:04}" + "x" * 8187 for n in range(4096)])], ["text"])

before = held()
rows = 0
for batch in grouped_by_bytes(batches(), 0, 1 << 20):
    rows += batch.num_rows
    texts = [t.encode() for t in batch.column(0).to_pylist()]
del batch, texts
assert rows == 4 * 4096
print(held() - before)
"""


def test_freed_memory_goes_back():
    """Workers outlive their tasks, so what a task has freed must not stay with them."""
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 50
