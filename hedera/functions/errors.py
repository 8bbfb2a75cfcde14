"""Errors, each with a code, the stage it arose in, details and a suggestion."""

from __future__ import annotations

import functools

import numpy as np


class EngineError(Exception):
    code = "engine.error"

    def __init__(self, message: str, *, code: str | None = None, stage: str | None = None, details: dict | None = None, suggestion: str | None = None):
        super().__init__(message)
        self.message, self.code, self.stage, self.details, self.suggestion = message, code or self.code, stage, details or {}, suggestion

    def to_dict(self) -> dict:
        return {"type": type(self).__name__, "code": self.code, "stage": self.stage, "message": self.message, "details": self.details, "suggestion": self.suggestion}


class InputError(EngineError, ValueError):
    code = "input.invalid"


class DataTypeError(InputError, TypeError):
    code = "input.type"


class ShapeError(InputError):
    code = "input.shape"


class MissingDataError(InputError):
    code = "input.missing"


class InvalidWeightError(InputError):
    code = "input.weights"


class SpecificationError(EngineError, ValueError):
    code = "specification.invalid"


class IdentificationError(EngineError, ValueError):
    code = "identification.failed"


class UnderidentifiedError(IdentificationError):
    code = "identification.underidentified"


class CollinearityError(IdentificationError, np.linalg.LinAlgError):
    code = "identification.collinear"


class ConvergenceError(EngineError, RuntimeError):
    code = "convergence.failed"


class NumericalError(EngineError, ArithmeticError):
    code = "numerical.failed"


class LinearAlgebraError(NumericalError, np.linalg.LinAlgError):
    code = "numerical.linear_algebra"


class DivergenceError(NumericalError):
    code = "numerical.divergence"


class InferenceError(EngineError, ValueError):
    code = "inference.failed"


class BootstrapError(EngineError, RuntimeError):
    code = "bootstrap.failed"


class OmittedVariableWarning(UserWarning):
    """A regressor was left out because others determine it."""


def error_boundary(stage: str):
    """Turns unexpected exceptions of a stage into EngineErrors that carry the stage; EngineErrors get the stage if they have none."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            try:
                return f(*args, **kwargs)
            except EngineError as e:
                e.stage = e.stage or stage
                raise
            except np.linalg.LinAlgError as e:
                raise LinearAlgebraError(str(e), stage=stage) from e
            except (FloatingPointError, OverflowError) as e:
                raise NumericalError(str(e), stage=stage) from e

        return run

    return wrap
