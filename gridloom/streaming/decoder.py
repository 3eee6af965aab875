"""Incremental LZ77 decoding of streams that arrive in pieces: state by stream id, one row when a message is complete."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.codecs import Lz77Decoder


def decode_stream(pieces: DataFrame, max_size: int | None = None) -> DataFrame:
    """stream_id, message for each complete message; pieces has stream_id, seq, piece (binary) in order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder = pickle.loads(state.get[0]) if state.exists else Lz77Decoder(max_size)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        done = []
        for piece in rows["piece"]:
            rest = bytes(piece)
            while rest and decoder.feed(rest):
                done.append(bytes(decoder.out))
                rest, decoder = decoder.remaining, Lz77Decoder(max_size)
        state.update((pickle.dumps(decoder),))
        yield pd.DataFrame({"stream_id": [key[0]] * len(done), "message": done})

    return pieces.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, message binary", "state binary", "append", GroupStateTimeout.NoTimeout)
