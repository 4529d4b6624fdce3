"""Complete, plausible conformations as packed vectors: the input of clustering (problem 1) and of neighbour search (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statewise.operators.anomalies import faulty_frames, frame_scores
from statewise.session import materialize, sized


def plausible(frames: DataFrame, n_atoms: int = 22) -> DataFrame:
    """``frame_id, vec`` of the frames that hold all atoms and are not faulty; a frame delivered again may appear again.

    The vectors come from the table that the fault finder wrote. Its few faulty ids are written too, counted, and excluded by a broadcast
    join below ``session.BROADCAST_ROWS`` rows, by a shuffled one above.
    """
    scores = frame_scores(frames, n_atoms, vectors=True)
    bad = materialize(faulty_frames(scores).select("frame_id"))
    return scores.select("frame_id", "vec").join(sized(bad), "frame_id", "left_anti")
