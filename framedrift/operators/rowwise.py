"""Steps given as functions of one packet, as Arrow table functions: no, one or several packets for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``function(frame, **params)``: the frame that takes the packet's place, several in a list, or None to drop it.
PacketFunction = Callable[..., bytes | list[bytes] | None]
#: ``function(frames, **params)``: the same for an Arrow array of frames, as an array of lists; null drops.
BatchFunction = Callable[..., pa.Array]

DROPPED, SINGLE, SEVERAL = range(3)


def _outcomes(function: PacketFunction | BatchFunction, batched: bool, params: dict, frames: pa.Array) -> list[tuple[int, list[bytes]]]:
    """For each frame what becomes of it. An empty list leaves it as it is."""
    if batched:
        found = function(frames, **params)
        if len(found) != len(frames):
            raise ValueError(f"{len(found)} lists for {len(frames)} frames")
        found = found.to_pylist()
    else:
        found = [function(frame, **params) for frame in frames.to_pylist()]
    out = []
    for frame, result in zip(frames.to_pylist(), found, strict=True):
        if result is None:
            out.append((DROPPED, []))
        elif isinstance(result, (bytes, bytearray)):
            out.append((SINGLE, [bytes(result)]))
        else:
            results = [bytes(r) for r in result]
            # A batch function has lists only: one frame in it is a plain edit.
            out.append((SINGLE if batched and len(results) == 1 else SEVERAL, results or [frame]))
    return out


def _replaced(rows: pa.RecordBatch, index: np.ndarray, columns: dict[str, pa.Array]) -> pa.Table:
    """Rows by number, with some columns given anew."""
    at = pa.array(index)
    names = rows.schema.names
    return pa.table([columns[n] if n in columns else rows.column(n).take(at) for n in names], names=names)


def _noted(before: pa.Array, own: np.ndarray, copies: np.ndarray, step: int) -> pa.Array:
    """``applied`` of rows, with ``step`` noted in ``own`` ones."""
    if pa.types.is_list(before.type):
        rows = zip(before.to_pylist(), own.tolist(), copies.tolist(), strict=True)
        return pa.array([([step] if copy else [*old, step]) if mine else old for old, mine, copy in rows], before.type)
    mask = before.to_numpy()
    return pa.array(np.where(own, np.where(copies, 1 << step, mask | (1 << step)), mask))


def row_function(
    schema: T.StructType, function: PacketFunction | BatchFunction, params: dict | None = None, batched: bool = False,
    flag: str | None = None, step: int | None = None, copy_unit: int = 1, lost_step: int | None = None,
):
    """An Arrow table function over rows of ``schema`` with ``frame``, ``copy_no`` and, where there is one, ``applied``.

    Rows whose ``flag`` is true (all, without one) and that have a frame go through ``function``; others
    pass. The first of several frames keeps the packet's ``copy_no``, the others get ``copy_unit`` times
    their number on top. ``step`` is noted in ``applied``, in copies alone. Dropped packets give no
    row, or a row without frame, lost at ``lost_step``, if that is given. ``_closed`` is set, where there
    is such a column, on packets that no later step may edit: lost ones and those of a list.
    """
    params = params or {}

    class Step:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            frames = rows.column("frame")
            wanted = np.asarray(frames.is_valid())
            if flag:
                wanted &= rows.column(flag).fill_null(False).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(wanted)
            if not len(hit):
                yield pa.Table.from_batches([rows])
                return
            outcomes = _outcomes(function, batched, params, frames.take(pa.array(hit)))
            kinds = np.full(rows.num_rows, SINGLE)
            kinds[hit] = [kind for kind, _ in outcomes]
            several = np.ones(rows.num_rows, np.int64)
            several[hit] = [len(found) or int(lost_step is not None) for _, found in outcomes]
            index = np.repeat(np.arange(rows.num_rows), several)
            nth = np.arange(len(index)) - np.repeat(np.cumsum(several) - several, several)
            made = pa.array([f for _, found in outcomes for f in found] + [None], frames.type)
            # Where each row's frame stands: among the old ones, or behind them among the new.
            place = np.where(wanted[index], rows.num_rows + len(made) - 1, index)
            filled = wanted[index] & (kinds[index] != DROPPED)
            place[filled] = rows.num_rows + np.arange(int(filled.sum()))
            kind, own = kinds[index], wanted[index]
            columns = {"frame": pa.concat_arrays([frames, made]).take(pa.array(place))}
            columns["copy_no"] = pa.array(rows.column("copy_no").to_numpy()[index] + nth * copy_unit)
            if step is not None:
                columns["applied"] = _noted(rows.column("applied").take(pa.array(index)), own, nth > 0, step)
            if "_closed" in rows.schema.names:
                before = rows.column("_closed").to_numpy(zero_copy_only=False)[index]
                columns["_closed"] = pa.array(before | (own & (kind != SINGLE)))
            if lost_step is not None:
                gone = own & (kind == DROPPED)
                lost = rows.column("lost_at").take(pa.array(index)).to_pylist()
                columns["lost_at"] = pa.array([lost_step if g else x for g, x in zip(gone.tolist(), lost, strict=True)], pa.int32())
            yield _replaced(rows, index, columns)

    return F.arrow_udtf(Step, returnType=schema)


def apply_rowwise(df: DataFrame, function: PacketFunction | BatchFunction, params: dict | None = None, batched: bool = False, **numbering) -> DataFrame:
    """``df`` after a step by row; see ``row_function``. Tasks stay as they are, nothing is shuffled."""
    return row_function(df.schema, function, params, batched, **numbering)(df.asTable())


def register_table_function(
    spark: SparkSession, name: str, schema: T.StructType, function: PacketFunction | BatchFunction, params: dict | None = None, batched: bool = False
) -> None:
    """Make the step callable in SQL: ``SELECT * FROM name(TABLE(packets))`` for packets of ``schema``."""
    spark.udtf.register(name, row_function(schema, function, params, batched))
