from corpus_data import odd_texts

from sitewise.llm.tokens import ChunkIds, default_path
from test_packing import whole_ids

import numpy as np
import pyarrow.parquet as pq

ODD = ["It's, he'll, we'd... o.k., a.b, c,d e, . , .. x.", "École, é. Å, ﬁne ǅ", "ΣΑΣ. Σ, İ. ß,", "a b c,　d.",
       "x\x1cy, z\x85w.", "<|endoftext|>, <|EndOfText|>. <|startoftext|>", "1,2 3. 4,", "日本語, 漢字. ひらがな", "á ́b é, ñ. ü",
       "mixed1 1mixed a1b2, --x-- (y), \"z\".", "no​break ﻿bom,", "🙂, 🙂🙂. a🙂,", "tab\tnew\nline\r\nret\x0bvt\x0cff", "ª º, ⅷ. ⓐ,"]


def test_ids_are_those_of_the_tokenizer():
    texts = ODD + [t or "" for _, t in odd_texts()]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    want = whole_ids(texts)
    for limit in (300_000, 50):
        memory = ChunkIds(default_path(), limit)
        got = [np.frombuffer(x, memory.dtype).tolist() for i in range(0, len(texts), 7)
               for x in memory.documents([t.encode() for t in texts[i:i + 7]])]
        assert got == want


def test_characters_that_stand_for_bytes():
    """One table for all bytes, the same as the byte-level alphabet."""
    from sitewise.llm.tokens import _BYTES, _CHARACTERS
    assert _CHARACTERS == bytes(range(256)).decode("latin-1").translate(_BYTES) and len(set(_CHARACTERS)) == 256
