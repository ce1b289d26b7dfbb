"""Weights as matrices are those of the counters, and replicates' sums are those of weighted rows."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from rebuff.functions import resample as R


def test_digits_are_md5():
    texts = [b"42:abusive:%d:%d" % (b, 7 ** b) for b in range(18)]
    blocks = np.zeros((len(texts), 64), np.uint8)
    for row, t in zip(blocks, texts):
        row[:len(t)] = np.frombuffer(t, np.uint8)
        row[len(t)] = 0x80
        row[56:58] = np.frombuffer((8 * len(t)).to_bytes(2, "little"), np.uint8)
    assert ["".join(f"{int(x):08x}" for x in d) for d in R.md5_digits(blocks)] == [hashlib.md5(t).hexdigest() for t in texts]


def test_sums_of_replicates(spark):
    rows = [(k if k % 5 else 10 ** 40 + k, "ab"[k % 2], k % 3, None if k % 7 == 0 else k * 0.5) for k in range(60)]
    u = spark.createDataFrame([(str(k), a, c, x) for k, a, c, x in rows], "k string, arm string, cell int, x double")
    reps = 1003
    old = R.multiplicities(u, "k", ["arm"], reps).groupBy("arm", "cell", "rep").agg(
        F.sum("_w").cast("double").alias("_n"), F.sum(F.col("_w") * F.col("x")).alias("x"), F.sum(F.when(F.col("x").isNotNull(), F.col("_w"))).cast("double").alias("n_x"))
    new = R.replicate_sums(u, "k", ["arm"], ["x"], reps, within=["cell"])
    a, b = ({(r.arm, r.cell, r.rep): (r._n, r.x, r.n_x) for r in d.select("arm", "cell", "rep", "_n", "x", "n_x").collect()} for d in (old, new))
    assert a == b and len(a) > 5000
    assert not any(word in new._jdf.queryExecution().optimizedPlan().toString() for word in ("Generate",))     # no weight is a row


def test_one_md5_call_per_tail_length():
    """A chunk's counters go through one vectorised md5, whatever the lengths of their block numbers; long ones still match hashlib."""
    import hashlib

    import numpy as np

    from rebuff.functions import resample as R
    calls, real = [], R.md5_digits
    R.md5_digits = lambda blocks: calls.append(len(blocks)) or real(blocks)
    try:
        for head, tails, size in (("42:a", [":12", ":34"], 1), ("42:a", [":1", ":345"], 2), ("42:" + "x" * 45, [":123"], 1)):
            calls.clear()
            got = R.weights(head, tails, 2000)
            assert len(calls) == size
            steps = R.poisson_steps()
            for k, t in enumerate(tails):
                digits = [hashlib.md5(f"{head}:{b}{t}".encode()).hexdigest()[8 * j:8 * j + 8] for b in range(500) for j in range(4)]
                assert got[k].tolist() == [sum(d >= s for s in steps) for d in digits]
    finally:
        R.md5_digits = real
    assert np.uint8 == got.dtype
