"""Token counts with a given subword vocabulary: Arrow batches in, lengths out.

In the piece vocabulary no piece holds a space mark after another character, so merges never cross from a word to the
space before the next one: every such place is a safe boundary. A batch is cut there, equal segments are encoded once,
and only their lengths are kept and added up per text. Batches are balanced by bytes, so one very long text is counted
in several rounds and a worker never holds the segments of more than one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: the mark that the vocabulary writes for a space
MARK = "▁"
BATCH_BYTES = 16 << 20
#: segments given to the encoder at once
ENCODE_AT_ONCE = 50_000


class PieceCounter:
    """Counts of one sentencepiece model whose normaliser changes nothing but spaces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece joins two words: this vocabulary has no safe boundary at spaces")

    def segments(self, texts: pa.Array) -> pa.ListArray:
        """Each text as segments that are encoded on their own: a word with the spaces before it beyond the first.

        The encoder adds one mark in front of what it gets, which stands for the first of those spaces (and for the
        mark it would add in front of the whole text).
        """
        plain = pc.replace_substring(texts, MARK, " ")
        # a space that follows a word is where segments part; it becomes the mark that the encoder adds itself
        parted = pc.replace_substring(plain, " ", MARK)
        odd = pc.or_(pc.match_substring(plain, "  "), pc.starts_with(plain, " "))
        if pc.any(odd).as_py():
            parted = pc.replace_with_mask(parted, odd, pc.replace_substring_regex(plain.filter(odd), "([^ ]) ", "\\1" + MARK))
        return pc.split_pattern(parted, MARK)

    def counts(self, texts: pa.Array) -> np.ndarray:
        lists = self.segments(texts.cast(pa.large_string()).fill_null(""))
        flat = lists.flatten().dictionary_encode()
        unique = flat.dictionary.to_numpy(zero_copy_only=False)
        lengths = np.empty(len(unique), np.int64)
        for at in range(0, len(unique), ENCODE_AT_ONCE):
            lengths[at:at + ENCODE_AT_ONCE] = [len(x) for x in self.model.encode(unique[at:at + ENCODE_AT_ONCE].tolist(), num_threads=1)]
        lengths[unique == ""] = 1  # an empty segment at the end of a text is a lone space
        per = lengths[flat.indices.to_numpy()]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        total = np.concatenate([[0], np.cumsum(per)])
        out = total[bounds[1:]] - total[bounds[:-1]]
        out[pc.equal(texts.fill_null(""), "").to_numpy(zero_copy_only=False)] = 0
        return out


def split_long(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters, cut before a space that follows a word; a part without one stays whole.

    The space at the cut is left out: the encoder adds it in front of the next part.
    """
    parts, low = [], 0
    while len(text) - low > size:
        at = low + size
        while True:
            at = text.find(" ", at)
            if at < 0 or text[at - 1] not in (" ", MARK):
                break
            at += 1
        if at < 0:
            break
        parts.append(text[low:at])
        low = at + 1
    return [*parts, text[low:]]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one; an empty table stays empty; columns
    of ``docs`` whose names clash with the new ones are replaced. Nothing is truncated. The model file must be readable at
    ``model_file`` on every worker.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def encode(batches):
        counter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            counter = counter or PieceCounter(model_file)
            column = batch.column(batch.schema.names.index("__text"))
            n_bytes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens = np.zeros(len(column), np.int64)
            group = np.cumsum(n_bytes) // batch_bytes  # consecutive texts of about batch_bytes together
            for g in np.unique(group):
                low, high = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
                long = low + np.flatnonzero(n_bytes[low:high] > batch_bytes)
                for i in long:
                    n_tokens[i] = sum(int(counter.counts(pa.array([p]))[0]) if p else 1 for p in split_long(column[int(i)].as_py(), batch_bytes // 4))
                short = np.setdiff1d(np.arange(low, high), long)
                if len(short):
                    n_tokens[short] = counter.counts(column.take(pa.array(short)))
            arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__text"]
            names = [name for name in batch.schema.names if name != "__text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[*names, *added])

    return docs.select(*[docs[c] for c in kept], docs[text].alias("__text")).mapInArrow(encode, schema)
