"""Keeping chunk statistics up to date as cameras change, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.runs import RunStore, cancellable
from ..sources.tables import checkpointed

_KEYS = ("scene", "cam_idx")
_POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw", "fov", "aspect", "near", "far", "enabled")


def changed_cameras(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cameras of either side whose pose or lens differs, with the pose on that side."""
    return old.select(*_KEYS, *_POSE).exceptAll(new.select(*_KEYS, *_POSE)).union(new.select(*_KEYS, *_POSE).exceptAll(old.select(*_KEYS, *_POSE)))


def dirty_chunks(space, chunks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks that a frustum, before or after, of a camera that changed may reach; disabled sides count for nothing.

    Frusta are held against chunks, not against points.
    """
    from ..operators.visibility import chunk_cameras

    return chunk_cameras(space, chunks, changed_cameras(old, new)).select("chunk_id").distinct()


def merge_stats(baseline: DataFrame, recomputed: DataFrame, dirty: DataFrame) -> DataFrame:
    """The baseline with the dirty chunks replaced."""
    return baseline.join(dirty, "chunk_id", "left_anti").unionByName(recomputed)


def recompute(space, chunks: DataFrame, points: DataFrame, old: DataFrame, new: DataFrame, baseline: DataFrame, stats: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Chunk statistics under ``new``: ``stats(points, cameras)`` runs over the dirty chunks only; ``points`` may be any relation with a chunk_id that it takes, the chunks too."""
    dirty = checkpointed(dirty_chunks(space, chunks, old, new))
    return merge_stats(baseline, stats(points.join(dirty, "chunk_id", "left_semi"), new), dirty)


def dirty_since(store: RunStore, space, chunks: DataFrame, new: DataFrame, about: dict) -> DataFrame | None:
    """The chunks to run again under ``new``, or None where the store's results can't be built on.

    They can if they are of the same settings, there is a line for every chunk, and both sides list the same cameras: a camera's number is its bit in every mask.
    """
    kept, old = (store.chunks(), store.cameras()) if store.about == about else (None, None)
    if kept is None or old is None or not chunks.select("chunk_id").exceptAll(kept).isEmpty():
        return None
    here, there = (c.select(*_KEYS) for c in (old, new))
    if not here.exceptAll(there).union(there.exceptAll(here)).isEmpty():
        return None
    return checkpointed(dirty_chunks(space, chunks, old, new))


def run(store: RunStore, space, chunks: DataFrame, points: DataFrame, cameras: DataFrame, stats: Callable[[DataFrame, DataFrame], DataFrame], settings: dict, tag: str = "run", incremental: bool = True) -> tuple[bool, DataFrame]:
    """Whether the run was incremental, and the chunk statistics under ``cameras``, which the store keeps.

    Only the chunks that the changed cameras may reach are run, if the store can be built on (``dirty_since``).  Chunks without points are answered for, but have no row.  A run that is
    stopped by ``cancel(spark, tag)`` raises ``RunCanceled``; it, or one that fails, leaves a store without results, as what it had may
    straddle two states of the cameras.  A run whose store was cleared meanwhile gives its rows, but isn't kept.
    """
    spark, token = points.sparkSession, store.generation
    try:
        with cancellable(spark, tag):
            dirty = dirty_since(store, space, chunks, cameras, settings) if incremental else None
            asked = chunks.select("chunk_id") if dirty is None else dirty
            rows = checkpointed(stats(points if dirty is None else points.join(dirty, "chunk_id", "left_semi"), cameras))
            kept = store.commit(token, rows, asked, settings, cameras.select(*_KEYS, *_POSE), dirty is not None)
    except Exception:
        store.drop(token)
        raise
    return dirty is not None, store.read() if kept else rows


def scoped(points: DataFrame, chunks: DataFrame, cameras: DataFrame, stats: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Statistics of the asked ``chunks`` (chunk_id) alone; no store is read or changed."""
    return stats(points.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"), cameras)


def edit_stream(edits: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply(edits of the batch, batch id)`` for every micro-batch of camera edits; the last edit of a camera in a batch counts."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*_KEYS).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in _KEYS]), "seq").alias("e"))
        apply(last.select(*_KEYS, "e.*"), number)

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
