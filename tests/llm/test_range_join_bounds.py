"""Copies that a task of the range join holds at a time."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import vectors


def test_copies_are_dealt_in_bounded_pieces(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 4))
    points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rid long, m long, v array<double>").coalesce(1)
    cells = vectors.Cells(vectors.units(list(x[:3])), 0.4)
    blocks, parts = dict.fromkeys(range(4), 1), dict.fromkeys(range(4), 50)
    whole = vectors.deal(points, cells, blocks, parts)
    bytes_of = whole.agg(F.sum(F.length("vecs"))).first()[0]
    assert bytes_of > 200 * 50 * 32
    monkeypatch.setattr(vectors, "DEAL_BYTES", 8192)
    pieces = vectors.deal(points, cells, blocks, parts).cache()
    # a row has 50 copies of 32 bytes and its visits: a piece has six rows at most
    assert pieces.agg(F.max(F.length("vecs"))).first()[0] <= 6 * 32
    assert pieces.agg(F.sum(F.length("vecs"))).first()[0] == bytes_of
