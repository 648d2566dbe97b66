"""Token counts of whole texts by a public tokenizer file, lengths only.

An Arrow function cuts the texts of a batch into parts, fills encoder calls
with parts up to a number of bytes and returns the sums of their lengths, so
neither ids nor more than one call's parts are held at a time.  A text longer
than ``part_bytes`` is cut at safe boundaries only: a single blank between two
characters that are neither blanks nor the vocabulary's blank mark.  Merges
join neighbouring characters along pieces of the vocabulary, and no piece has
a blank mark after another character (``cuts_are_safe``), so none reaches over
such a blank; the part behind it starts with the blank mark that the encoder
puts before every text, in place of the blank.  A text without such a place
stays whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a blank in the vocabulary
_MARK = MARK.encode()


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


def cuts_are_safe(pieces: list[str]) -> bool:
    """Whether no piece goes on over a blank."""
    return all(MARK not in p.lstrip(MARK) for p in pieces)


def safe_cut(text: bytes, at: int) -> int:
    """First place of a blank from ``at`` on that can be left out as a cut,
    -1 if there is none."""
    while (i := text.find(b" ", at)) >= 0:
        before, after = text[max(i - 3, 0):i], text[i + 1:i + 4]
        if before and after and before[-1:] != b" " and after[:1] != b" " and before != _MARK and after != _MARK:
            return i
        at = i + 1
    return -1


def parts(text: bytes, size: int) -> list[bytes]:
    """The text cut at safe places into parts of about ``size`` bytes."""
    out, start = [], 0
    while len(text) - start > size:
        # blanks right at the start of a part are no safe places of it
        cut = safe_cut(text, start + size)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut + 1
    out.append(text[start:])
    return out


class Lengths:
    """Numbers of ids of texts, encoded in calls of about ``call_bytes``."""

    def __init__(self, path: str, call_bytes: int, part_bytes: int):
        self.call_bytes = call_bytes
        if path.endswith(".model"):
            import sentencepiece
            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: processor.encode(texts, num_threads=1)
            pieces = processor.id_to_piece(list(range(processor.get_piece_size())))
            self.part_bytes = part_bytes if cuts_are_safe(pieces) else None
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            self.part_bytes = None  # other vocabularies: texts stay whole

    def of(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        call, owner, held = [], [], 0
        for i, text in enumerate(texts):
            whole = self.part_bytes is None or len(text) <= self.part_bytes
            for part in [text] if whole else parts(text, self.part_bytes):
                call.append(part)
                owner.append(i)
                held += len(part)
                if held >= self.call_bytes:
                    self._add(out, call, owner)
                    call, owner, held = [], [], 0
        self._add(out, call, owner)
        return out

    def _add(self, out: np.ndarray, call: list[bytes], owner: list[int]) -> None:
        if call:
            np.add.at(out, owner, [len(ids) for ids in self.encode(call)])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None,
                 limit: int = 4096, call_bytes: int = 1 << 18, part_bytes: int = 1 << 14) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``
    tokens); one row per input row.

    ``path`` is a sentencepiece ``.model`` or a tokenizers ``.json`` file; the
    count is that of the library on the whole text, without added tokens,
    truncation or padding.  ``call_bytes`` and ``part_bytes`` bound what is
    encoded at a time and change no count.  Defined cases: a null text counts
    as an empty one, with no bytes and no tokens; rows that repeat, and null
    or shared ids, are counted row by row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    path = path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))

    def count(batches):
        lengths = Lengths(path, call_bytes, part_bytes)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n = lengths.of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return body.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
