"""Bitmaps of hashes: bounded prefilters that may let too much pass, never too little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 15


def cells_for(n: int, each: int, least: int, most: int) -> int:
    """A power of two of about `each` cells for each of n members, between least and most."""
    return min(most, max(least, 1 << (each * n).bit_length()))


def bitmap(places: DataFrame, cells: int) -> bytes:
    """Bits set at the places (one bigint column, 0 to cells - 1), packed where the shuffle brings them together."""

    def pack(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            owner, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(owner, kind="stable")
            names, first = np.unique(owner[order], return_index=True)
            for name, own in zip(names.tolist(), np.split(at[order], first[1:])):
                chunks.setdefault(name, np.zeros(CHUNK, bool))[own] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()),
                                          pa.array([np.packbits(b).tobytes() for b in chunks.values()], pa.binary())], ["chunk", "bits"])

    name = places.columns[0]
    parts = max(1, cells // CHUNK // 512)  # some 500 chunks, 16 MB unpacked, at once
    found = (places.selectExpr(f"`{name}` div {CHUNK} AS chunk", f"CAST(`{name}` % {CHUNK} AS INT) AS at").repartition(parts, "chunk")
             .mapInArrow(pack, "chunk bigint, bits binary").toArrow())
    bits = np.zeros((cells // CHUNK, CHUNK // 8), np.uint8)
    for chunk, own in zip(found["chunk"].to_pylist(), found["bits"]):
        bits[chunk] = np.frombuffer(own.as_buffer(), np.uint8)
    return bits.tobytes()


def tester(raw: bytes, cells: int):
    """A test of unsigned 64-bit hashes against a bitmap of their low bits."""
    bits = np.frombuffer(raw, np.uint8)

    def passes(h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(cells - 1)).astype(np.int64)
        return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1

    return passes
