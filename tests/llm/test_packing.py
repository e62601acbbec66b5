import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinloom.llm import packing
from pinloom.llm.common import Scratch
from pinloom.llm.tokens import vocabulary_path
from tests.llm.conftest import docs_frame


def brute(lengths, size, order):
    """The rule word for word: of all open gaps and a new bin, the smallest sum of squares; an open bin at ties, the tightest."""
    gaps = []
    for i in order:
        n, choices = lengths[i], []
        for rank, g in [(0, g) for g in sorted({x for x in gaps if x >= n})] + [(1, size)]:
            new = list(gaps)
            if rank == 0:
                new.remove(g)
            if g - n:
                new.append(g - n)
            choices.append((sum(new.count(x) ** 2 for x in set(new)), rank, g, new))
        gaps = min(choices)[-1]
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_rule(lengths):
    array = np.array(lengths, np.int64)
    order = packing.placing_order(array)
    bins, offsets = packing.sum_of_squares(array, 20, order)
    used = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        used[b].append((o, n))
    gaps = []
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 20
        gaps += [20 - at] * (at < 20)
    assert sorted(gaps) == brute(lengths, 20, order.tolist())


@pytest.mark.parametrize("per_packer", [3, 100_000])
def test_pack_documents(spark, per_packer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    docs = docs_frame(spark)
    pieces = packing.pieces_of(docs, vocabulary_path(), max_tokens=64)
    rows = packing.pack(pieces, Scratch(spark, "test"), 64, per_packer).collect()
    want = []
    for d in docs.collect():
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 1]
        want += [(d.doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64


def test_empty(spark):
    pieces = packing.pieces_of(docs_frame(spark).limit(0), vocabulary_path())
    assert packing.pack(pieces, Scratch(spark, "test")).count() == 0
