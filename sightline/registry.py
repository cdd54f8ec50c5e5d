"""Methods by name: functions from DataFrames to a DataFrame, with their inputs, options and evaluator."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sightline.functions.parsing import expand_placeholders, resolve_options


@dataclass(frozen=True)
class Method:
    """``run(inputs, options)``; ``evaluate(result, truth)`` gives long rows ``metric, value``."""

    name: str
    requires: tuple[str, ...]
    run: Callable[[Mapping[str, DataFrame], Mapping[str, str]], DataFrame]
    defaults: Mapping[str, str] = field(default_factory=dict)
    evaluate: Callable[[DataFrame, DataFrame], DataFrame] | None = None


_METHODS: dict[str, Method] = {}


def register(name: str, requires: tuple[str, ...] = (), evaluate=None, **defaults: str):
    """Decorator that makes a function available by name."""

    def put(run):
        _METHODS[name.lower()] = Method(name, requires, run, defaults, evaluate)
        return run

    return put


def method(name: str) -> Method:
    try:
        return _METHODS[name.lower()]
    except KeyError:
        raise KeyError(f"no method {name!r}; there are {sorted(_METHODS)}") from None


def names() -> list[str]:
    return sorted(m.name for m in _METHODS.values())


def build(name: str, inputs: Mapping[str, DataFrame] | None = None, from_file: Mapping[str, str] | None = None, truth: DataFrame | None = None, load: Callable[[str], DataFrame] | None = None, **at_run: str):
    """Run a method: inputs as given, else loaded from the option of their name; the result, or with a truth
    the result and its evaluation."""
    m = method(name)
    options = resolve_options(m.defaults, from_file, at_run)
    options = {k: expand_placeholders(v, options) if isinstance(v, str) else v for k, v in options.items()}
    given = dict(inputs or {})
    for need in m.requires:
        if need not in given:
            if load is None or need not in options:
                raise ValueError(f"{m.name} needs {need}")
            given[need] = load(options[need])
    result = m.run(given, options)
    if truth is None or m.evaluate is None:
        return result
    return result, m.evaluate(result, truth)


def chain(steps: list[tuple[str, str]], inputs: Mapping[str, DataFrame], **options: str) -> dict[str, DataFrame]:
    """Run methods one after another; each step's result is an input, under its own name, of the later ones."""
    package = dict(inputs)
    for name, output in steps:
        package[output] = build(name, package, **options)
    return package
