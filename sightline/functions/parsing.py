"""Strings to values: options, names, lists, codes and labels, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_BASE = 2147483647  # fixed value of the pair code: id1 * (2^31 - 1) + id2
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1", "on"), ("false", "no", "0", "off")
DESCRIPTOR_KINDS = {"float": ("SIFT", "SURF", "KAZE", "SUPERPOINT"), "binary": ("ORB", "BRISK", "AKAZE", "FREAK", "BRIEF")}


def option(value: Column, kind: str, default) -> Column:
    """An option as ``kind``, or the default where it is missing or is no such value."""
    return F.coalesce(F.trim(value).try_cast(kind), F.lit(default).cast(kind))


def option_bool(value: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(default)


def expand_placeholders(text: str, values: Mapping[str, str], depth: int = 8) -> str:
    """``{key}`` replaced by its value, again in what it gives; unknown keys stay."""
    for _ in range(depth):
        further = re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), text)
        if further == text:
            break
        text = further
    return text


def read_ini(text: str, load=None) -> dict[str, dict[str, str]]:
    """Sections of an INI text. ``@inherit=name`` in a section, or before any, takes over what ``load(name)`` or
    another section gives; later values win, so a file's own values override inherited ones."""
    out: dict[str, dict[str, str]] = {}
    section = ""
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].split(";;", 1)[0].strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
            out.setdefault(section, {})
        elif line.startswith("@inherit"):
            name = line.partition("=")[2].strip() or line[len("@inherit") :].strip()
            if name in out:
                out.setdefault(section, {}).update({k: v for k, v in out[name].items() if k not in out[section]})
            elif load is not None:
                for other, values in read_ini(load(name), load).items():
                    out.setdefault(other, {}).update({k: v for k, v in values.items() if k not in out.get(other, {})})
        elif "=" in line:
            key, _, value = line.partition("=")
            out.setdefault(section, {})[key.strip()] = value.strip()
    return out


def resolve_options(defaults: Mapping[str, str], from_file: Mapping[str, str] | None = None, at_run: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options by precedence: given at run time, else from the file, else the default."""
    return {**defaults, **(from_file or {}), **(at_run or {})}


def parse_intrinsics(text: Column, least: int = 9) -> Column:
    """Numbers separated by commas or semicolons; null if fewer than ``least`` or any is no number."""
    values = F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(values) >= least) & ~F.exists(values, lambda x: x.isNull()), values)


def pair_id(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("long") * PAIR_BASE + F.greatest(a, b).cast("long")


def split_pair_id(pair: Column) -> tuple[Column, Column]:
    second = F.pmod(pair, F.lit(PAIR_BASE))
    return F.floor((pair - second) / F.lit(PAIR_BASE)).cast("long"), second


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./\\]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def dataset_name(path: Column) -> Column:
    """The folder above ``images``, else the last part of the path."""
    trimmed = F.regexp_replace(path, r"[/\\]+$", "")
    above = F.regexp_extract(trimmed, r"([^/\\]+)[/\\]+images$", 1)
    return F.when(above != "", above).otherwise(F.regexp_extract(trimmed, r"([^/\\]+)$", 1))


def smart_commit(commit: Column) -> tuple[Column, Column]:
    """``prefix_number`` as (prefix, number); both null for anything else."""
    prefix = F.regexp_extract(commit, r"^(.*)_(-?\d+(?:\.\d+)?)$", 1)
    number = F.regexp_extract(commit, r"^(.*)_(-?\d+(?:\.\d+)?)$", 2).try_cast("double")
    return F.when(number.isNotNull(), prefix), number


def label_of(labels: Mapping[str, Column]) -> Column:
    """``k=v_k=v`` of named values."""
    return F.concat_ws("_", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in labels.items()])


def labels_of(label: Column) -> Column:
    return F.str_to_map(label, F.lit("_"), F.lit("="))


def format_value(value: Column) -> Column:
    """Four decimals; from 10000 on with separators of thousands."""
    return F.when(F.abs(value) >= 10000, F.format_number(value, 4)).otherwise(F.format_string("%.4f", value))


def listed(text: Column) -> Column:
    """Parts of a comma list, trimmed and in lower case, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def aliased(name: Column, aliases: Mapping[str, str]) -> Column:
    """A name in lower case, or what it is an alias of."""
    lowered = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
    return F.coalesce(table[lowered], lowered)


def descriptor_kind(name: Column) -> Column:
    upper = F.upper(F.trim(name))
    return F.when(upper.isin(*DESCRIPTOR_KINDS["float"]), "float").when(upper.isin(*DESCRIPTOR_KINDS["binary"]), "binary")
