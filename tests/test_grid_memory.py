"""The grid of variants holds few fits on the driver at a time."""

import threading
import time

from credence.plans import train


def test_few_fits_at_once(spark, monkeypatch):
    lock, running, most = threading.Lock(), [0], [0]

    def fit(*_):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        with lock:
            running[0] -= 1

    monkeypatch.setattr(train, "_fit", fit)
    rows = spark.createDataFrame(
        [(k, f"word{k} a", k % 11, k % 2, "known" if k % 3 else "listed") for k in range(40)],
        "doc_id long, sentence string, sentiment int, polarity int, corpus string",
    )
    runs = train.run_variants(rows, "doc_id", 30)
    assert len(runs) == 24 and len({tuple(v.values()) for v, _ in runs}) == 24
    assert most[0] <= 2
