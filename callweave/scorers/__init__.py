"""Models that Spark jobs call in batches on the executors."""

from callweave.scorers.interface import Encoder, FrameModel, PairClassifier, TextModel, ZeroShotClassifier

__all__ = ["Encoder", "FrameModel", "PairClassifier", "TextModel", "ZeroShotClassifier"]
