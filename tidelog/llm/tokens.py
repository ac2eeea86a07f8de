"""Token counts: Arrow batches go to the tokenizer, only lengths come back.

Batches are cut by bytes, not rows, on their way from Spark and before they are
encoded, so that one batch costs about as much as another whatever the lengths of
its texts, and a text beyond the limit is split
at safe boundaries: before a single space that follows a character other than a
space. No piece of the vocabulary has a space mark after another character (this
is checked when the model is loaded), so no merge crosses such a boundary, and
the mark that the library puts before each part is the one of the space.

Defined cases: null and empty texts have 0 bytes and 0 tokens; null and repeated
doc_ids are rows like any other; an empty table gives no rows; other columns are
ignored; texts without any safe boundary are encoded in one part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MODEL = "piece_bpe_32k.model"
BATCH_BYTES = 1 << 20
PART_CHARS = 16_384
SAFE = re.compile(r"(?<=[^ ]) (?=[^ ])")
MARK = "▁"


def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    if crossing or model.encode("a b") != model.encode("a") + model.encode("b"):
        raise ValueError(f"{path}: texts can't be split at spaces for this model")
    return model


def parts(text: str, chars: int = PART_CHARS) -> list[str]:
    """The text in parts of about `chars` characters that encode on their own; the boundary's space is dropped."""
    out, begin = [], 0
    while len(text) - begin > chars:
        m = SAFE.search(text, begin + chars)
        if m is None or MARK in text:
            break
        out.append(text[begin : m.start()])
        begin = m.end()
    return [*out, text[begin:]]


def counter(path: str, id_col: str, text_col: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            sizes, counts = [len((t or "").encode()) for t in texts], [0] * len(texts)
            todo, owner, held = [], [], 0

            def flush():
                for i, ids in zip(owner, model.encode(todo, num_threads=1), strict=True):
                    counts[i] += len(ids)
                todo.clear(), owner.clear()

            for i, t in enumerate(texts):
                cut = parts(t) if t else ()
                for part in cut:
                    todo.append(part)
                    owner.append(i)
                    held += sizes[i] if len(cut) == 1 else len(part.encode())
                    if held >= batch_bytes:
                        flush()
                        held = 0
            if todo:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row a document, no shuffle."""
    out = common.bounded(docs).select(id_col, text_col).mapInArrow(counter(model_path, id_col, text_col, batch_bytes), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
