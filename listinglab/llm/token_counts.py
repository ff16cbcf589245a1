"""Token counts: batches of near equal bytes go to the tokenizer, and only lengths come back."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8


def safe_parts(text: str, most: int) -> Iterator[str]:
    """`text` in parts of about `most` characters, cut only at a single space between two
    letters or digits, without that space. The normaliser turns some characters into spaces and
    drops others, but never letters or digits, so the space stays a single one. No piece of the
    vocabulary has U+2581 behind another character, so no merge crosses such a place, and the
    prefix that the tokenizer puts before the next part stands for the space. A text without
    such places stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _can_split(sp) -> bool:
    """Whether the model is one for which `safe_parts` is exact."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any("▁" in p.lstrip("▁") for p in pieces)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = 1 << 20, part_chars: int = 1 << 15) -> DataFrame:
    """Tokens of each row's whole text under the sentencepiece file `model`, a path that all
    executors have: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No begin, end
    or special tokens are added; special strings in a text are ordinary text.

    Nothing is shuffled: scan partitions are of near equal bytes, and inside one the texts
    are gathered into batches of `batch_bytes` bytes and one part at most; texts above
    `part_chars` are cut at places that no merge crosses, so a batch stays small however long a
    text is. Null and empty
    texts have 0 tokens; repeated rows and null ids are counted like others; other columns
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        split = _can_split(sp)
        for batch in batches:
            counts, parts, owners, held = [0] * batch.num_rows, [], [], 0

            def flush(counts=counts, parts=parts, owners=owners) -> None:
                for i, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
                    counts[i] += len(ids)
                parts.clear()
                owners.clear()

            for i, raw in enumerate(batch.column("b")):
                text = raw.as_py().decode("utf-8", "replace")
                for part in safe_parts(text, part_chars) if split else [text]:
                    parts.append(part)
                    owners.append(i)
                    held += len(part.encode("utf-8", "replace"))
                    if held >= batch_bytes:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), utf8("text").alias("b"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
