"""Packed ids against the public tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestar.llm")
from lodestar.llm import packing  # noqa: E402


def test_packed_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    draw = random.Random(6)
    alphabet = ["a", "B", "the ", "  ", "\n", "\t\t", "é", "ß", "\U0001f600", "日本", "1234567", "'s", "’", " ", "-", "́", *special]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(1, 80))) for _ in range(120)] + ["x " * 3000, "", None, special[0] if special else "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in packing.pack_documents(docs, capacity=1024, eos=2).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
