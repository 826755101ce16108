"""Constraints over methods, types, parameters, fields and integers as Columns.

A constraint is a dict (as in a JSON model generator) or a list of them, which must all hold.
Patterns match whole strings.  A pattern without special characters becomes an equality, which
Catalyst pushes to the scan, and other patterns are guarded by a required substring.

Types are seen through a :class:`TypeView`.  By default a method's class is described by its
columns ``class``, ``super`` and ``ancestors`` and its other types by their names alone;
:func:`with_type_infos` adds what is known of every type, for :data:`INFORMED`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LITERAL = re.compile(r"(?:[\w;/<> :#,-]|\\[.$()\[\]|*+?{}^\\])*")
_ATOM = re.compile(r"(\\.|[^\\])([?*+]*)", re.DOTALL)
LEAST_SUBSTRING = 3


def literal_of(pattern: str) -> str | None:
    """The one string that ``pattern`` matches, if there is only one."""
    return re.sub(r"\\(.)", r"\1", pattern) if _LITERAL.fullmatch(pattern) else None


def required_substring(pattern: str) -> str | None:
    """The longest run of plain characters that every match must hold; none if unsure."""
    atoms = _ATOM.findall(pattern)
    if "".join(map("".join, atoms)) != pattern:
        return None
    runs = [""]
    for atom, times in atoms:
        if atom in "|([{" or (atom[0] == "\\" and atom[1].isalnum()):
            return None
        plain = atom[0] == "\\" or atom not in ".^$"
        if not plain or times[:1] in ("?", "*"):
            runs.append("")
            continue
        runs[-1] += atom[-1]
        if times:  # one or more: what follows need not touch what came before
            runs.append("")
    best = max(runs, key=len)
    return best if len(best) >= LEAST_SUBSTRING else None


def matches(column: Column, pattern: str) -> Column:
    """Whether the whole of ``column`` matches ``pattern``."""
    exact = literal_of(pattern)
    if exact is not None:
        return column == exact
    whole = column.rlike(f"^(?:{pattern})$")
    must = required_substring(pattern)
    return column.contains(must) & whole if must else whole


_COMPARE: dict[str, Callable] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    """Some part holds; true for no parts at all."""
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def _logic(constraint: dict | list, rec: Callable[[dict], Column]) -> Column | None:
    """The connectives, alike for every subject."""
    if isinstance(constraint, list):
        return all_of([rec(c) for c in constraint])
    kind = constraint["constraint"]
    if kind in ("all_of", "any_of"):
        _expect(constraint, "inners")
        parts = [rec(c) for c in constraint.get("inners") or []]
        return all_of(parts) if kind == "all_of" else any_of(parts)
    if kind == "not":  # what is unknown does not hold, so its negation does
        _expect(constraint, "inner")
        return ~F.coalesce(rec(constraint["inner"]), F.lit(False))
    return None


def _expect(constraint: dict, *keys: str) -> None:
    odd = set(constraint) - {"constraint", *keys}
    if odd:
        raise ValueError(f"constraint {constraint['constraint']!r} does not take {', '.join(sorted(odd))}")


def _unknown(constraint: dict, subject: str) -> ValueError:
    return ValueError(f"unknown constraint {constraint['constraint']!r} on a {subject}")


def integer_where(constraint: dict | list, number: Column) -> Column:
    """A comparison; the number is the left side."""
    logic = _logic(constraint, lambda c: integer_where(c, number))
    if logic is not None:
        return logic
    if constraint["constraint"] not in _COMPARE:
        raise _unknown(constraint, "number")
    _expect(constraint, "value")
    return _COMPARE[constraint["constraint"]](number, constraint["value"])


def annotated(annotations: Column, constraint: dict) -> Column:
    """An annotation of the type, with a value that matches where a pattern is given."""
    _expect(constraint, "type", "pattern")
    value = constraint.get("pattern")
    return F.exists(annotations, lambda a: (a["type"] == constraint["type"]) & (matches(a["value"], value) if value else F.lit(True)))


@dataclass(frozen=True)
class TypeView:
    """What is known of a type: its name, direct super, ancestors (names, itself included), flags
    and annotations."""

    name: Column
    super: Column | None = None
    ancestors: Column | None = None
    rest: Column | None = None  # a struct with the flags and annotations

    @staticmethod
    def of(info: Column) -> TypeView:
        return TypeView(info["name"], info["super"], info["ancestors"], info)


def type_where(constraint: dict | list, t: TypeView) -> Column:
    logic = _logic(constraint, lambda c: type_where(c, t))
    if logic is not None:
        return logic
    kind = constraint["constraint"]
    if kind == "name":
        _expect(constraint, "pattern", "name")
        return t.name == constraint["name"] if "name" in constraint else matches(t.name, constraint["pattern"])
    if kind == "extends" and t.ancestors is not None:
        _expect(constraint, "inner", "pattern", "include_self")
        inner = _inner(constraint)
        own = F.lit(True) if constraint.get("include_self", True) else None
        return F.exists(t.ancestors, lambda a: type_where(inner, TypeView(a)) & (own if own is not None else a != t.name))
    if kind == "super" and t.super is not None:
        _expect(constraint, "inner", "pattern")
        return type_where(_inner(constraint), TypeView(t.super))
    if kind in ("is_class", "is_interface", "is_enum") and t.rest is not None:
        _expect(constraint, "value")
        return t.rest[kind] == F.lit(constraint.get("value", True))
    if kind == "has_annotation" and t.rest is not None:
        return annotated(t.rest["annotations"], constraint)
    raise _unknown(constraint, "type of which only its name is known" if t.rest is None else "type")


def _inner(constraint: dict) -> dict | list:
    """The nested type constraint; a pattern alone is one on the name."""
    if ("inner" in constraint) == ("pattern" in constraint):
        raise ValueError(f"constraint {constraint['constraint']!r} takes one of inner and pattern")
    return constraint["inner"] if "inner" in constraint else {"constraint": "name", "pattern": constraint["pattern"]}


def parameter_where(constraint: dict | list, parameter: Column, informed: bool) -> Column:
    """A constraint on a parameter: on its annotations, or on its type."""
    logic = _logic(constraint, lambda c: parameter_where(c, parameter, informed))
    if logic is not None:
        return logic
    if constraint["constraint"] == "parameter_has_annotation":
        if not informed:
            raise _unknown(constraint, "parameter of which only its type is known")
        return annotated(parameter["parameter_annotations"], constraint)
    return type_where(constraint, TypeView.of(parameter) if informed else TypeView(parameter))


@dataclass(frozen=True)
class Scope:
    """Where a method's types are described."""

    informed: bool = False

    def parent(self) -> TypeView:
        return TypeView.of(F.col("class_info")) if self.informed else TypeView(F.col("class"), F.col("super"), F.col("ancestors"))

    def returned(self) -> TypeView:
        return TypeView.of(F.col("ret_info")) if self.informed else TypeView(F.col("ret"))

    def parameters(self) -> str:
        return "param_infos" if self.informed else "params"

    def signature(self) -> Column:
        short = F.concat_ws(".", "class", "name")
        return F.concat(short, F.lit(":("), F.concat_ws("", "params"), F.lit(")"), F.col("ret")) if self.informed else short


PLAIN, INFORMED = Scope(), Scope(informed=True)


def where(constraint: dict | list, scope: Scope = PLAIN) -> Column:
    """The Column of a constraint over the columns of a table of methods."""
    logic = _logic(constraint, lambda c: where(c, scope))
    if logic is not None:
        return logic
    kind = constraint["constraint"]
    if kind == "name":
        _expect(constraint, "pattern", "name")
        return F.col("name") == constraint["name"] if "name" in constraint else matches(F.col("name"), constraint["pattern"])
    if kind == "names":
        return F.col("name").isin(constraint["names"])
    if kind in ("signature", "signature_pattern"):
        _expect(constraint, "pattern")
        return matches(scope.signature(), constraint["pattern"])
    if kind == "signature_match":
        return _signature_match(constraint, scope.parent)
    if kind == "parent":
        _expect(constraint, "inner", "pattern")
        return type_where(_inner(constraint), scope.parent())
    if kind in ("super", "extends"):
        return type_where(constraint, scope.parent())
    if kind == "return":
        _expect(constraint, "inner", "pattern")
        return type_where(_inner(constraint), scope.returned())
    if kind == "parameter":
        _expect(constraint, "idx", "inner", "pattern")
        inner = _inner(constraint)
        return F.coalesce(parameter_where(inner, F.get(scope.parameters(), constraint["idx"]), scope.informed), F.lit(False))
    if kind == "any_parameter":
        _expect(constraint, "start_idx", "inner", "pattern")
        start, inner, params = constraint.get("start_idx") or 0, _inner(constraint), scope.parameters()
        some = F.slice(params, start + 1, F.greatest(F.size(params) - start, F.lit(0)))
        return F.exists(some, lambda p: parameter_where(inner, p, scope.informed))
    if kind in ("number_parameters", "number_overrides"):
        column = F.coalesce("n_params" if kind == "number_parameters" else "n_overrides", F.lit(0))
        if "operator" in constraint:  # the short form
            return integer_where({"constraint": constraint["operator"], "value": constraint["value"]}, column)
        _expect(constraint, "inner")
        return integer_where(constraint["inner"], column)
    if kind in ("is_static", "is_constructor", "is_native", "has_code", "is_class", "is_interface", "is_enum"):
        _expect(constraint, "value")
        return F.col(kind) == F.lit(constraint.get("value", True))
    if kind == "visibility":
        _expect(constraint, "is")
        if constraint["is"] not in ("public", "private", "protected"):
            raise ValueError("a visibility is public, private or protected")
        return F.col("visibility") == constraint["is"]
    if kind == "has_annotation":
        return annotated(F.col("annotations"), constraint)
    if kind == "bytecode":
        _expect(constraint, "pattern")
        return F.col("code").rlike(constraint["pattern"])
    raise _unknown(constraint, "method")


def _signature_match(constraint: dict, parent: Callable[[], TypeView]) -> Column:
    _expect(constraint, "name", "names", "parent", "parents", "extends", "include_self")
    if sum(k in constraint for k in ("name", "names")) > 1 or sum(k in constraint for k in ("parent", "parents", "extends")) > 1:
        raise ValueError("signature_match takes one of name and names and one of parent, parents and extends")
    parts = []
    if "name" in constraint or "names" in constraint:
        parts.append(F.col("name").isin(constraint["names"]) if "names" in constraint else F.col("name") == constraint["name"])
    if "extends" in constraint:
        names = constraint["extends"] if isinstance(constraint["extends"], list) else [constraint["extends"]]
        inner = {"constraint": "any_of", "inners": [{"constraint": "name", "name": n} for n in names]}
        parts.append(type_where({"constraint": "extends", "inner": inner, "include_self": constraint.get("include_self", True)}, parent()))
    elif "parents" in constraint:
        parts.append(F.col("class").isin(constraint["parents"]))
    elif "parent" in constraint:
        parts.append(F.col("class") == constraint["parent"])
    if not parts:
        raise ValueError("signature_match takes a name or a parent")
    return all_of(parts)


def field_where(constraint: dict | list, scope: Scope = PLAIN) -> Column:
    """The Column of a constraint over a table of fields (name, class, type, is_static, annotations)."""
    logic = _logic(constraint, lambda c: field_where(c, scope))
    if logic is not None:
        return logic
    kind = constraint["constraint"]
    if kind == "name":
        _expect(constraint, "pattern", "name")
        return F.col("name") == constraint["name"] if "name" in constraint else matches(F.col("name"), constraint["pattern"])
    if kind in ("signature", "signature_pattern"):
        _expect(constraint, "pattern")
        return matches(F.concat("class", F.lit("."), "name", F.lit(":"), "type"), constraint["pattern"])
    if kind == "signature_match":
        return _signature_match(constraint, scope.parent)
    if kind == "is_static":
        _expect(constraint, "value")
        return F.col("is_static") == F.lit(constraint.get("value", True))
    if kind == "has_annotation":
        return annotated(F.col("annotations"), constraint)
    if kind == "parent":
        _expect(constraint, "inner", "pattern")
        return type_where(_inner(constraint), scope.parent())
    raise _unknown(constraint, "field")


_INFO = ["super", "ancestors", "is_class", "is_interface", "is_enum", "annotations"]


def with_type_infos(rows: DataFrame, infos: DataFrame, id_col: str = "method_id", returned: bool = True, parameters: bool = True) -> DataFrame:
    """``rows`` with ``class_info``, ``ret_info`` and ``param_infos``: what ``infos(type, super,
    ancestors, is_class, is_interface, is_enum, annotations)`` knows of each type; of a type that
    is not listed only the name.  ``param_annotations``, where it exists, holds an array of
    annotations for each parameter."""
    known = infos.select(F.col("type").alias("__type"), F.struct(*_INFO).alias("__info"))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema["__info"].dataType.fields}

    def described(name: Column, *more: Column) -> Column:
        own = [F.coalesce("__info.ancestors", F.array(name)) if k == "ancestors" else F.col(f"__info.{k}").cast(kinds[k]) for k in _INFO]
        return F.struct(name.alias("name"), *[c.alias(k) for c, k in zip(own, _INFO)], *more)

    columns = rows.columns
    for column, out in (("class", "class_info"), ("ret", "ret_info"))[: 2 if returned else 1]:
        rows = rows.join(known, F.col(column) == F.col("__type"), "left").withColumn(out, described(F.col(column))).drop("__type", "__info")
    if not parameters:
        return rows
    notes = F.get("param_annotations", F.col("i")) if "param_annotations" in columns else F.array().cast("array<struct<type:string,value:string>>")
    each = rows.select(F.col(id_col).alias("__id"), F.posexplode("params").alias("i", "p"), *(["param_annotations"] if "param_annotations" in columns else []))
    each = each.join(known, F.col("p") == F.col("__type"), "left").select("__id", "i", described(F.col("p"), notes.alias("parameter_annotations")).alias("info"))
    listed = each.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "info"))), lambda x: x["info"]).alias("param_infos"))
    empty = F.array().cast(listed.schema["param_infos"].dataType)
    return rows.join(listed, F.col(id_col) == F.col("__id"), "left").withColumn("param_infos", F.coalesce("param_infos", empty)).drop("__id")
