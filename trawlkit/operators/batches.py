"""Arrow batches for Python workers, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of input that a Python worker works on at a time.
PIECE_BYTES = 8 << 20


def frugal(run):
    """``run`` (Arrow batches to Arrow batches) fed with pieces of bounded size, its worker's free memory given back.

    A batch holds as many rows whether texts are short or long, and a worker
    that is reused from stage to stage keeps what it once allocated.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                step = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, PIECE_BYTES))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
                del batch
                give_back()

        yield from run(pieces())
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc: there is no such call, and none is needed
