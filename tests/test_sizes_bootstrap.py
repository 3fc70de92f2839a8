"""Resamples by row number in arrays of bounded length."""

import numpy as np
import pytest

from folioscope.operators import paired


def plain(values, reps):
    n = len(values)
    return [sum(values[(((r + 1) * 1103515245 + (i + 1) * 12345 + (r + 7) * (i + 3) * (i + 3) * 7919) % 2147483647) % n] for i in range(n)) for r in reps]


def test_chunks_sum_to_whole_resamples():
    values, reps = np.random.default_rng(2).normal(size=501), np.array([0, 1, 9_999, 5_000_000_000])
    parts = sum(paired.resample_sums(values[at : at + 200], at, 501, reps) for at in range(0, 501, 200))
    assert parts.tolist() == pytest.approx(plain(values.tolist(), reps.tolist()))


def test_row_numbers_do_not_overflow():
    # With more than 340,000 values the product behind a row number leaves 64 bits.
    n, rep = 400_000, 9_999
    where = sum(((((rep + 1) * 1103515245 + (i + 1) * 12345 + (rep + 7) * (i + 3) ** 2 * 7919) % 2147483647) % n) for i in range(n))
    assert paired.resample_sums(np.arange(n, dtype=float), 0, n, np.array([rep]))[0] == where


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_interval_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(paired, "CHUNK", chunk)
    rows = [(k * 37 % 101, float(k % 5)) for k in range(50)] + [(1000, None)]
    ordered = [v for _, v in sorted(r for r in rows if r[1] is not None)]
    means = sorted(s / len(ordered) for s in plain(ordered, range(200)))
    got = paired.bootstrap_mean(spark.createDataFrame(rows, "k long, d double").repartition(3), "d", ["k"], 200).first()
    assert (got["replicates"], got["lo"], got["hi"]) == (200, pytest.approx(means[5]), pytest.approx(means[195]))
    none = paired.bootstrap_mean(spark.createDataFrame(rows[-1:], "k long, d double"), "d", ["k"], 200).first()
    assert (none["lo"], none["hi"]) == (None, None)
