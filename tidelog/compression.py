"""Blocks compressed with zstandard, plainly or with a dictionary trained on some of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that a dictionary is trained on, and of the dictionary.
SAMPLE_BLOCKS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16 << 20, 16 << 10


def train(blocks: DataFrame, payload: str, order: list[str]) -> bytes:
    """A dictionary of at most SAMPLE_BLOCKS blocks and SAMPLE_BYTES of them, those of the least hash of their
    key; empty if they are too few to train one."""
    import zstandard

    size = F.octet_length(payload)
    rows = blocks.where(size <= SAMPLE_BYTES // SAMPLE_BLOCKS).orderBy(F.xxhash64(*order), *order).limit(SAMPLE_BLOCKS).select(payload).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r[0]) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _each(blocks: DataFrame, payload: str, make) -> DataFrame:
    schema = blocks.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for b in batches:
            i = b.schema.get_field_index(payload)
            done = pa.array([None if x is None else change(x) for x in b.column(i).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([done if k == i else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return blocks.mapInArrow(run, schema)


def compressed(blocks: DataFrame, payload: str, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    def make():
        import zstandard as z

        return (z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(dictionary)) if dictionary else z.ZstdCompressor(level=level)).compress

    return _each(blocks, payload, make)


def decompressed(blocks: DataFrame, payload: str, dictionary: bytes = b"") -> DataFrame:
    def make():
        import zstandard as z

        return (z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary)) if dictionary else z.ZstdDecompressor()).decompress

    return _each(blocks, payload, make)
