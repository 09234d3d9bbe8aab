"""Monthly-panel risk analytics on Spark DataFrames."""

from almanac.spec import PanelSpec, ScoreSpec

__all__ = ["PanelSpec", "ScoreSpec"]
