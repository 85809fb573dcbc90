"""Sizes of texts in tokens, batch by batch inside tasks.

Two measures: the plain one counts matches of ``\\p{Punct}|[^\\p{Punct}\\s]+`` with ASCII classes,
each punctuation mark and each run of anything else between white space; the other asks a public
byte-pair tokenizer, whose file must be readable under the given path on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.sources.tables import spread

#: Where the public vocabulary lies unless a caller says otherwise.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text looked at in one go.
SLICE_BYTES = 4 << 20

WORD, SPACE, PUNCT = 0, 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(b" \t\n\x0b\f\r")] = SPACE
CLASSES[[b for b in range(33, 127) if not chr(b).isalnum()]] = PUNCT


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a token starts at each place of one text, given the places' classes."""
    word = classes == WORD
    out = word.copy()
    out[1:] &= ~word[:-1]
    out |= classes == PUNCT
    return out


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SLICE_BYTES each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(texts)])


def count_tokens(texts: pa.Array) -> np.ndarray:
    """Plain size of each text; null counts 0."""
    out = np.zeros(len(texts), np.int64)
    for a, b in slices(texts):
        part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        classes = CLASSES[data]
        begins = token_starts(classes)
        full = np.flatnonzero(np.diff(offsets))
        first = offsets[full]
        begins[first] = classes[first] != SPACE  # the text before doesn't reach into this one
        if len(full):
            out[a + full] = np.add.reduceat(begins, first, dtype=np.int64)
    return out


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token id."""
    encoding = encoder(path)
    return np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], np.int64)


def measured(documents: DataFrame, *, doc_id: str, text: str, keep: list[str] = (), tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, the ``keep`` columns and ``n_tokens`` of every row; null texts have size 0.

    ``tokenizer`` is the path of a vocabulary, None the plain measure. Only the named columns are
    read.
    """
    columns = [doc_id, *keep]
    schema = T.StructType([documents.schema[c] for c in columns] + [T.StructField("n_tokens", T.LongType())])
    narrow = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            if tokenizer is None:
                sizes = count_tokens(texts)
            else:
                encode = encoder(tokenizer).encode_ordinary
                sizes = np.array([0 if t is None else len(encode(t)) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in range(len(columns))], pa.array(sizes)], names=schema.names)

    return spread(narrow).mapInArrow(work, schema)
