"""Playbooks: named steps over DataFrames, with templates, checks before running, and an audit table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Step = dict[str, Any]
Operator = Callable[..., DataFrame]
_REF = re.compile(r"\{\{\s*([^}]+?)\s*\}\}")
_STEP = re.compile(r"steps\.(\d+)(?:\.value)?$")


class Playbook:
    """Steps {"op": name, "args": {...}} run in order; an argument {{params.x}} is a parameter, {{steps.0}} the result of an earlier step."""

    def __init__(self, name: str, steps: list[Step], params: dict[str, Any] | None = None):
        if not steps:
            raise ValueError(f"{name}: no steps")
        self.name, self.steps, self.params = name, steps, params or {}

    def problems(self, operators: dict[str, Operator]) -> list[str]:
        """What is wrong before anything runs; nothing, if it can run."""
        out = []
        for i, step in enumerate(self.steps):
            if step["op"] not in operators:
                out.append(f"step {i}: no operator named {step['op']}")
            for ref in _REF.findall(json.dumps(step.get("args", {}))):
                if m := _STEP.match(ref):
                    if int(m[1]) >= i:
                        out.append(f"step {i}: {ref} isn't an earlier step")
                elif ref.startswith("params."):
                    if ref[7:] not in self.params:
                        out.append(f"step {i}: {ref} isn't a parameter")
                else:
                    out.append(f"step {i}: {ref} is neither a parameter nor a step")
        return out

    def run(self, operators: dict[str, Operator], **params: Any) -> list[DataFrame]:
        """The results of all steps, as lazy DataFrames; an error before the first if there are problems."""
        if found := self.problems(operators):
            raise ValueError("; ".join(found))
        given, results = {**self.params, **params}, []

        def put(value: Any) -> Any:
            if isinstance(value, dict):
                return {k: put(v) for k, v in value.items()}
            if isinstance(value, list):
                return [put(v) for v in value]
            if not isinstance(value, str):
                return value
            if (m := _REF.fullmatch(value)) is not None:
                return results[int(s[1])] if (s := _STEP.match(m[1])) else given[m[1][7:]]
            return _REF.sub(lambda m: str(given[m[1][7:]]), value)

        for step in self.steps:
            results.append(operators[step["op"]](**put(step.get("args", {}))))
        return results

    def audit(self, spark: SparkSession, results: list[DataFrame]) -> DataFrame:
        """(playbook, step, op, args, columns) of a run."""
        rows = [(self.name, i, s["op"], json.dumps(s.get("args", {}), sort_keys=True), r.columns) for i, (s, r) in enumerate(zip(self.steps, results, strict=True))]
        return spark.createDataFrame(rows, "playbook string, step int, op string, args string, columns array<string>")


def check_arguments(schema: dict[str, Any], args: dict[str, Any]) -> list[str]:
    """What of args breaks a schema of properties (type, enum, minimum, maximum) and required names."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    out = [f"{n} is missing" for n in schema.get("required", []) if n not in args]
    for n, v in args.items():
        if (p := schema.get("properties", {}).get(n)) is None:
            out.append(f"{n} isn't known")
            continue
        if "type" in p and (not isinstance(v, kinds[p["type"]]) or isinstance(v, bool) and p["type"] in ("integer", "number")):
            out.append(f"{n} isn't of type {p['type']}")
            continue
        if "enum" in p and v not in p["enum"]:
            out.append(f"{n} is none of {p['enum']}")
        if "minimum" in p and v < p["minimum"] or "maximum" in p and v > p["maximum"]:
            out.append(f"{n} is out of range")
    return out
