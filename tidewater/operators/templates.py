"""Model templates: what a matched method or field becomes, as rows of one table.

A row says (id, role, kind, port, output, features).  ``port`` is the input of a propagation and
the place of everything else; ``output`` belongs to propagations alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.predicates import PLAIN, Scope, parameter_where

#: Columns of a model row beside the id.
ROW = "role string, kind string, port string, output string, features array<string>"

_TAINTS = ("generations", "parameter_sources", "sources", "sinks", "effect_sources", "effect_sinks")
_ATTACHED = ("attach_to_sources", "attach_to_sinks", "attach_to_propagations", "add_features_to_arguments")
_NAMES = ("modes", "freeze")
_KEYS = {*_TAINTS, *_ATTACHED, *_NAMES, "propagation", "sanitizers", "for_all_parameters"}


def split_source(port: str) -> str:
    """Sources on Return are generations, on an argument parameter sources."""
    return "parameter_sources" if port.startswith("Argument") else "generations"


def entries(model: dict) -> list[tuple[str, str | None, str | None, str | None, list[str]]]:
    """The rows of a template (role, kind, port, output, features) that do not depend on the method."""
    odd = set(model) - _KEYS
    if odd:
        raise ValueError(f"a model does not take {', '.join(sorted(odd))}")
    rows = []
    for role in _TAINTS:
        for t in model.get(role, []):
            port = t.get("port", "Return" if role in ("generations", "sources") else None)
            kind = f"{t['kind']}({t['subkind']})" if t.get("subkind") else t["kind"]
            rows.append((split_source(port) if role == "sources" else role, kind, port, None, t.get("features", [])))
    for p in model.get("propagation", []):
        transforms = ":".join(p["transforms"]) if p.get("transforms") else None
        rows.append(("propagation", transforms, p["input"], p["output"], p.get("features", []) + (["no-collapse"] if p.get("collapse") is False else [])))
    for s in model.get("sanitizers", []):
        for kind in s.get("kinds") or [None]:  # no kinds stand for all
            rows.append((f"sanitize_{s['sanitize']}", kind, s.get("port"), None, []))
    for role in _ATTACHED:
        rows += [(role, None, a["port"], None, a["features"]) for a in model.get(role, [])]
    for role in _NAMES:
        rows += [(role, name, None, None, []) for name in model.get(role, [])]
    return rows


def _literal(rows: list) -> Column:
    fields = [f.split(" ")[0] for f in ROW.split(", ")]
    made = [F.struct(*[(F.array(*map(F.lit, v)) if v else F.array()).cast("array<string>").alias(n) if n == "features" else F.lit(v).cast("string").alias(n) for n, v in zip(fields, row)]) for row in rows]
    return F.array(*made)


def instantiate(matched: DataFrame, model: dict, id_col: str = "method_id", scope: Scope = PLAIN) -> DataFrame:
    """Rows of ``model`` for every row of ``matched``; the template travels as a literal, so there
    is no join.  ``for_all_parameters`` repeats its part for each parameter that fits."""
    parts = []
    fixed = entries(model)
    if fixed:
        parts.append(matched.select(F.col(id_col).alias("id"), F.explode(_literal(fixed)).alias("r")))
    for block in model.get("for_all_parameters", []):
        name = block["variable"]
        repeated = entries({k: v for k, v in block.items() if k not in ("variable", "where")})
        bound = matched.select(F.col(id_col).alias("id"), F.posexplode(scope.parameters()).alias("i", "p"))
        bound = bound.where(parameter_where(block.get("where", []), F.col("p"), scope.informed))
        sign = re.escape(f"({name})")
        put = lambda c: F.regexp_replace(c, sign, F.concat(F.lit("("), F.col("i").cast("string"), F.lit(")")))
        rows = bound.select("id", "i", F.explode(_literal(repeated)).alias("r"))
        parts.append(rows.select("id", F.struct("r.role", "r.kind", put(F.col("r.port")).alias("port"), put(F.col("r.output")).alias("output"), "r.features").alias("r")))
    if not parts:
        return matched.sparkSession.createDataFrame([], f"id long, {ROW}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("id", "r.*")
