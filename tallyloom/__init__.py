"""Analytics for model-evaluation datasets on Spark."""

import importlib

from .errors import TallyloomError

__version__ = "0.2.0"
#: What a user of the package mostly needs, by the module that has it; modules are loaded when they are asked for.
_FROM = {
    "Settings": "plans.config", "RunFolder": "plans.runs", "RunResult": "plans.runs", "Experiment": "plans.experiments", "build": "plans.experiments", "prompts": "plans", "report": "plans", "evaluate": "operators.evaluate",
    "score": "operators.evaluate", "summarise": "operators.evaluate", "register_scorer": "operators.evaluate", "manifest": "sources", "questions": "sources", "media": "sources", "register_functions": "functions.registered",
}
__all__ = ["TallyloomError", "__version__", *_FROM]


def __getattr__(name: str):
    if name not in _FROM:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    where = f"{__name__}.{_FROM[name]}"
    if name in ("prompts", "report", "manifest", "questions", "media"):
        return importlib.import_module(f"{where}.{name}")
    return getattr(importlib.import_module(where), name)
