"""Corrections that a project states in YAML files: people, institutions, labels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: An institution's own id.
OWN_ID = re.compile(r"[A-Za-z0-9._:-]{1,64}")


class CorrectionError(ValueError):
    """The file says something that cannot be meant."""


@dataclass
class People:
    together: list[list[str]] = field(default_factory=list)
    apart: list[list[str]] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)


def _load(uri: str, fields: dict[str, type]) -> dict[str, Any]:
    """Sections of a file by name; none for a file that is not there, empty sections as empty."""
    system, where = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if system.get_file_info(where).type != fs.FileType.File:
        return {name: kind() for name, kind in fields.items()}
    with system.open_input_stream(where) as f:
        try:
            data = yaml.safe_load(f.read().decode()) or {}
        except yaml.YAMLError as e:
            raise CorrectionError(f"{uri} is no YAML: {e}") from None
    if not isinstance(data, dict):
        raise CorrectionError(f"{uri} has to have sections: {', '.join(fields)}")
    if unknown := sorted(set(data) - set(fields)):
        raise CorrectionError(f"{uri}: {', '.join(map(str, unknown))} is not one of {', '.join(fields)}")
    out = {name: kind() if data.get(name) is None else data[name] for name, kind in fields.items()}
    for name, kind in fields.items():
        if not isinstance(out[name], kind):
            raise CorrectionError(f"{uri}: {name} has to be a {kind.__name__}")
    return out


def read_people(uri: str) -> People:
    """``together`` and ``apart``: lists of lists of ids; ``names``: an id's name."""
    data = _load(uri, {"together": list, "apart": list, "names": dict})
    for name in ("together", "apart"):
        for group in data[name]:
            if not isinstance(group, list) or not all(isinstance(x, str) for x in group):
                raise CorrectionError(f"{uri}: each item of {name} is a list of ids in brackets, as [source:A1, source:A2]")
            if name == "apart" and len(group) != 2:
                raise CorrectionError(f"{uri}: each item of apart is a pair, {group} has {len(group)}")
    return People(data["together"], data["apart"], {str(k): str(v) for k, v in data["names"].items()})


def mention_pairs(spark: SparkSession, groups: list[list[str]], ids: DataFrame) -> DataFrame:
    """(a, b): pairs of mentions that groups of ids join or part; ``ids`` has (id, mention), an id naming any of its mentions.

    Of two ids of a pair that share mentions, the narrower one keeps them.
    """
    rows = [(n, side, str(x)) for n, group in enumerate(groups) for side, x in enumerate(group)]
    listed = spark.createDataFrame(rows, "n int, side int, id string").join(ids.select("id", "mention"), "id")
    sizes = listed.groupBy("n", "side").count()
    sized = listed.join(sizes, ["n", "side"])
    own = sized.alias("x").join(sized.alias("y"), "n").where("x.mention = y.mention AND x.side <> y.side AND (x.count > y.count OR (x.count = y.count AND x.side < y.side))").selectExpr("n", "x.side AS side", "x.mention AS mention")
    left = listed.join(own, ["n", "side", "mention"], "left_anti")
    return left.alias("x").join(left.alias("y"), "n").where("x.side < y.side").selectExpr("x.mention AS a", "y.mention AS b").distinct()


def read_institutions(spark: SparkSession, uri: str) -> tuple[dict[str, str], DataFrame]:
    """Aliases (text to id), and institutions (institution, name, country, state) that the project adds or changes."""
    data = _load(uri, {"aliases": dict, "institutions": dict})
    rows = []
    for key, own in data["institutions"].items():
        if not isinstance(key, str) or not OWN_ID.fullmatch(key):
            raise CorrectionError(f"{uri}: {key!r} is no id: letters without accents, digits and . _ : - up to 64")
        if not isinstance(own, dict) or set(own) - {"name", "country", "state"}:
            raise CorrectionError(f"{uri}: {key} has name, country and state")
        rows.append((key, own.get("name"), own.get("country"), own.get("state")))
    return {str(k): str(v) for k, v in data["aliases"].items()}, spark.createDataFrame(rows, "institution string, name string, country string, state string")


def read_labels(spark: SparkSession, uri: str) -> DataFrame:
    """(topic, label) that are written by hand and go before all others."""
    data = _load(uri, {"topics": dict})
    try:
        rows = [(int(k), str(v)) for k, v in data["topics"].items()]
    except (TypeError, ValueError):
        raise CorrectionError(f"{uri}: topics are numbers") from None
    return spark.createDataFrame(rows, "topic int, label string")
