"""Models kept in a registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd


@dataclass(frozen=True)
class RegisteredModel:
    """A model logged with MLflow, addressed by its URI and given a frame with the column ``text``.

    MLflow is imported where the model is loaded, so only the executors that use it need it.
    """

    model_uri: str

    def load(self) -> Callable[[Sequence[str]], Sequence[str]]:
        import mlflow.pyfunc

        model = mlflow.pyfunc.load_model(self.model_uri)
        def run(prompts: Sequence[str]) -> Sequence[str] | str:
            answers = model.predict(pd.DataFrame({"text": list(prompts)}))
            return answers if isinstance(answers, str) else list(answers)

        return run


@dataclass(frozen=True)
class RegisteredFrameModel:
    """A model logged with MLflow whose signature has several columns: ``inputs`` names those of the frame that it is given, ``outputs`` is
    the schema of what it returns. A model that returns one column without a name gives it the one of ``outputs``."""

    model_uri: str
    inputs: tuple[str, ...]
    outputs: str

    def load(self) -> Callable[[pd.DataFrame], pd.DataFrame]:
        import mlflow.pyfunc

        model = mlflow.pyfunc.load_model(self.model_uri)
        names = [field.split()[0].rstrip(":") for field in self.outputs.split(",")]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            found = model.predict(frame)
            return found if isinstance(found, pd.DataFrame) else pd.DataFrame({names[0]: list(found)})

        return run
