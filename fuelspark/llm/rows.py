"""Arrow plumbing of the operators: a function over texts, run batch by batch inside the tasks.

Defined results: a null text counts as empty wherever an operator's docstring says nothing else; columns that the
operator doesn't name are kept only if asked for, and a result column replaces a kept one of the same name.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of input that one call of an operator's function sees, but for a single longer row.
SLICE_BYTES = 2_000_000

ARROW_TYPES = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch, column: int, limit: int | None = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the bytes of one column of texts."""
    if limit is None or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_rows(
    df: DataFrame, keep: list[str], inputs: list[str | F.Column], fields: list[tuple[str, str]],
    start: Callable[[], Callable[..., list]], limit: int | None = SLICE_BYTES,
) -> DataFrame:
    """Rows of ``df`` with the columns ``keep`` and the new ``fields``.

    ``start`` runs once per task and returns a function from the input columns (Arrow arrays) to a list or array
    per field. The first input is the text by which batches are cut to bounded parts, unless ``limit`` is None.
    """
    names = [name for name, _ in fields]
    keep = [c for c in keep if c not in names]
    taken = [F.col(quoted(c)) if isinstance(c, str) else c for c in inputs]
    part = df.select(*[F.col(quoted(c)) for c in keep], *[c.alias(f"_input_{i}") for i, c in enumerate(taken)])
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    n_keep, types = len(keep), [ARROW_TYPES[t] for _, t in fields]

    def run(batches):
        work = start()
        for batch in batches:
            for piece in slices(batch, n_keep, limit):
                made = work(*piece.columns[n_keep:])
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n_keep], *new], names=[*keep, *names])

    return part.mapInArrow(run, schema)


def crc_remainder(id_column: F.Column, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def sample_fraction(df: DataFrame, key: F.Column, fraction: float) -> DataFrame:
    """A share of the rows, the same ones on every run: those whose hashed key is small."""
    if fraction >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30))))
