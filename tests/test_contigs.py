"""Skew and rotation of sequences in pieces, as of whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import contigs


@pytest.fixture(scope="module")
def seqs(spark):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("ACGTNacgt") for _ in range(n))
    return spark.createDataFrame([("a", make(7_301)), ("b", make(1_000)), ("short", make(150)), ("just", make(201)), ("none", ""), ("at", "AT" * 700), (None, make(300))], "name string, seq string")


def rounded(df):
    return sorted((r.name or "", r.pos, None if r.skew is None else round(r.skew, 9), round(r.accum, 7)) for r in df.collect())


@pytest.mark.parametrize("size", [1_000, 77])
def test_windows(seqs, size):
    named = seqs.where("name IS NOT NULL")
    pieces = contigs.cut_pieces(named, "name", "seq", size)
    assert rounded(contigs.piece_windows(pieces, "name", 200, 50)) == rounded(S.windows(named, "name", "seq", 200, 50))


def test_whole_sequences_are_looked_at_in_pieces(seqs, monkeypatch):
    letters = S._letters(seqs.where("name = 'a'").first().seq)
    whole = [[x.tolist() for x in part] for part in S._skews(letters, 200, 50)]
    monkeypatch.setattr(S, "PIECE", 330)
    parts = [[x.tolist() for x in part] for part in S._skews(letters, 200, 50)]
    assert len(whole) == 1 and len(parts) > 10
    assert [sum((p[k] for p in parts), []) for k in range(3)] == whole[0]


@pytest.mark.parametrize("size", [1_000, 77])
def test_rotation(seqs, size):
    named = seqs.where("name IS NOT NULL AND seq != ''")
    pieces = contigs.cut_pieces(named, "name", "seq", size)
    shifts = contigs.least_skew_place(pieces, "name", 200, 50)
    whole = {r.name: r.seq for r in S.reoriented(named, "name", "seq", 200, 50, short=True).collect()}
    turned = contigs.rotated_pieces(pieces, shifts, "name")
    assert turned.agg(F.max(F.length("piece"))).first()[0] <= size
    got = {}
    for r in sorted(turned.collect(), key=lambda r: r.start):
        assert len(got.get(r.name, "")) == r.start
        got[r.name] = got.get(r.name, "") + r.piece
    assert got == whole
