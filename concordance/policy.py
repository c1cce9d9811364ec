"""Recipes: the reviewed, closed policies that say how two datasets are compared.

A recipe is JSON.  It is read into frozen dataclasses; unknown fields, missing
decisions and contradictions are errors before any input is opened.  The effective
policy is the recipe with its defaults filled in, and its canonical JSON is hashed to
the policy's fingerprint.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path
from typing import Any

SIDES = ("baseline", "candidate")
TYPES = ("string", "integer", "decimal", "float", "boolean", "date", "timestamp")
NUMERIC = ("integer", "decimal", "float")
NORMALIZATIONS = ("trim", "casefold", "unicode_nfc")
MEASURES = ("count", "sum", "min", "max")
#: Recipe versions by mode; 4 to 6 are 1 to 3 with a projection of fields.
MODES = {1: "keyed", 2: "aggregate", 3: "multiset", 4: "keyed", 5: "aggregate", 6: "multiset"}
PROJECTIONS = ("direct-v1", "json-pointer-v1", "xml-field-v1")
#: How values are admitted: by their type, strictly.
STRICT = "semantic-scalar-v1"

#: Fields of a recipe for all modes, and for one mode each.
COMMON_FIELDS = {"recipe_version", "comparison_mode", "scope", "columns", "output", "delimiters", "null_tokens", "excluded_columns", "column_mappings", "field_projection", "input_projection"}
MODE_FIELDS = {"keyed": {"keys", "identity", "nulls_equal"}, "aggregate": {"group_by", "measures"}, "multiset": set()}


class PolicyError(ValueError):
    """A recipe or plan that can't be accepted."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise PolicyError(message)


def closed(value: Any, where: str, needed: set[str], optional: set[str] = frozenset()) -> dict:
    """The value, if it is an object with just these fields."""
    require(isinstance(value, dict), f"{where} must be an object")
    unknown, missing = set(value) - needed - set(optional), needed - set(value)
    require(not unknown, f"{where} has unknown fields: {', '.join(sorted(map(str, unknown)))}")
    require(not missing, f"{where} lacks {', '.join(sorted(missing))}")
    return value


def texts(value: Any, where: str, at_least: int = 0) -> list[str]:
    """The value, if it is a list of different, nonempty strings."""
    good = isinstance(value, list) and all(isinstance(x, str) and x for x in value) and len(value) == len(set(value))
    require(good and len(value) >= at_least, f"{where} must list different nonempty strings")
    return value


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class Tolerance:
    """``abs(r - l) <= absolute + relative * max(abs(l), abs(r))``, bounds included."""

    absolute: Decimal
    relative: Decimal

    @classmethod
    def of(cls, value: Any, where: str) -> Tolerance:
        closed(value, f"{where}.tolerance", {"formula", "absolute", "relative"})
        require(value["formula"] == "symmetric-v1", f"{where} must use the symmetric-v1 formula")
        try:
            found = [Decimal(str(value[x])) for x in ("absolute", "relative")]
        except InvalidOperation:
            raise PolicyError(f"{where}.tolerance is no number") from None
        require(all(x.is_finite() and x >= 0 for x in found), f"{where}.tolerance must be finite and not negative")
        return cls(*found)


@dataclass(frozen=True)
class Field:
    """How a column is read and compared."""

    name: str
    type: str
    scale: int | None = None
    tolerance: Tolerance | None = None
    normalize: tuple[str, ...] = ()
    sources: tuple[str, str] = ("", "")

    @classmethod
    def of(cls, name: str, value: Any, exact_only: str | None, mapping: dict) -> Field:
        where = f"columns.{name}"
        closed(value, where, {"type"}, {"comparison", "tolerance", "timezone", "scale", "normalize"})
        kind, comparison = value["type"], value.get("comparison", "exact")
        require(kind in TYPES, f"{where}.type is unknown")
        require(comparison in ("exact", "numeric"), f"{where}.comparison is unknown")
        require(comparison == "exact" or exact_only is None, f"{where} must be compared exactly: {exact_only}")
        if kind == "timestamp":
            require(value.get("timezone") == "require-aware", f"{where}.timezone must be require-aware")
        else:
            require(value.get("timezone") is None, f"{where}.timezone is for timestamps")
        scale = value.get("scale")
        if kind == "decimal":
            require(type(scale) is int and scale >= 0, f"{where}.scale must be a whole number of at least 0")
        else:
            require(scale is None, f"{where}.scale is for decimals")
        tolerance = None
        if comparison == "numeric":
            require(kind in NUMERIC, f"{where} must have a numeric type for numeric comparison")
            tolerance = Tolerance.of(value.get("tolerance"), where)
        else:
            require(value.get("tolerance") is None, f"{where}.tolerance is for numeric comparison")
        normalize = texts(value.get("normalize", []), f"{where}.normalize")
        require(set(normalize) <= set(NORMALIZATIONS), f"{where}.normalize has an unknown rule")
        require(not normalize or kind == "string", f"{where}.normalize is for strings")
        return cls(name, kind, scale, tolerance, tuple(normalize), tuple(mapping.get(s, name) for s in SIDES))


@dataclass(frozen=True)
class Measure:
    """An aggregate of a group; ``column`` is None for a count."""

    name: str
    operator: str
    column: str | None = None
    reject_nulls: bool = True
    tolerance: Tolerance | None = None

    @classmethod
    def of(cls, name: str, value: Any, columns: dict[str, Field]) -> Measure:
        where = f"measures.{name}"
        closed(value, where, {"operator"}, {"column", "nulls", "comparison", "tolerance"})
        operator = value["operator"]
        require(operator in MEASURES, f"{where}.operator is unknown")
        if operator == "count":
            require(set(value) == {"operator"}, f"{where} is a count and takes nothing else")
            return cls(name, operator)
        column = value.get("column")
        require(column in columns, f"{where}.column must be a configured column")
        require(value.get("nulls") in ("reject", "ignore"), f"{where}.nulls must be reject or ignore")
        kind = columns[column].type
        require(operator != "sum" or kind in ("integer", "decimal"), f"{where} can sum integers and decimals only")
        comparison, tolerance = value.get("comparison", "exact"), None
        require(comparison in ("exact", "numeric"), f"{where}.comparison is unknown")
        if comparison == "numeric":
            require(kind in ("integer", "decimal"), f"{where} needs an integer or decimal column for a tolerance")
            tolerance = Tolerance.of(value.get("tolerance"), where)
        else:
            require(value.get("tolerance") is None, f"{where}.tolerance is for numeric comparison")
        return cls(name, operator, column, value["nulls"] == "reject", tolerance)


@dataclass(frozen=True)
class Recipe:
    mode: str
    columns: dict[str, Field]
    keys: tuple[str, ...] = ()
    nulls_equal: bool = True
    group_by: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    expected_empty: bool = False
    raw: bool = False
    delimiters: tuple[str, str] = (",", ",")
    null_tokens: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    excluded: tuple[str, ...] = ()
    source: dict = field(default_factory=dict, compare=False)

    @property
    def values(self) -> list[Field]:
        """The columns that are compared, in the order of the recipe."""
        return [f for n, f in self.columns.items() if n not in self.keys]

    @property
    def fingerprint(self) -> str:
        return digest(effective_policy(self))


def load_recipe(path: str | Path) -> Recipe:
    """Read a recipe file; a repeated field is an error."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        require(len(pairs) == len({k for k, _ in pairs}), "a field is repeated")
        return dict(pairs)

    return parse_recipe(json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=once))


def parse_recipe(value: Any) -> Recipe:
    require(isinstance(value, dict) and value.get("recipe_version") in MODES and type(value["recipe_version"]) is int, "recipe_version must be 1 to 6")
    mode = MODES[value["recipe_version"]]
    require(value.get("comparison_mode") == mode, f"comparison_mode must be {mode} for this recipe_version")
    own = MODE_FIELDS[mode]
    closed(value, "recipe", {"scope", "columns", "recipe_version", "comparison_mode"} | own, COMMON_FIELDS)
    scope = closed(value["scope"], "scope", {"snapshot", "cutoff", "filters", "completeness", "expected_empty"})
    require(all(isinstance(scope[x], str) and scope[x] for x in ("snapshot", "cutoff")), "scope.snapshot and scope.cutoff must be nonempty strings")
    require(isinstance(scope["filters"], list) and all(isinstance(x, str) and x for x in scope["filters"]), "scope.filters must list nonempty strings")
    require(scope["completeness"] == "full", "scope.completeness must be full")
    require(isinstance(scope["expected_empty"], bool), "scope.expected_empty must be true or false")
    require(value.get("input_projection", STRICT) == STRICT, f"input_projection must be {STRICT}")
    projected = value["recipe_version"] > 3
    require(projected == ("field_projection" in value), "recipe versions 4 to 6, and they only, have a field_projection")
    require(not projected or ("input_projection" in value and "column_mappings" not in value), f"recipe versions 4 to 6 need input_projection {STRICT} and take no column_mappings")
    output = closed(value.get("output", {"sensitivity": "summary"}), "output", {"sensitivity"})
    require(output["sensitivity"] in ("summary", "raw"), "output.sensitivity must be summary or raw")
    delimiters = closed(value.get("delimiters", dict.fromkeys(SIDES, ",")), "delimiters", set(SIDES))
    require(all(isinstance(x, str) and len(x) == 1 and x not in '"\r\n\0' for x in delimiters.values()), "a delimiter is one character, no quote, line end or NUL")
    tokens = closed(value.get("null_tokens", {s: [] for s in SIDES}), "null_tokens", set(SIDES))
    columns = value["columns"]
    require(isinstance(columns, dict) and columns and all(isinstance(x, str) and x for x in columns), "columns must be a nonempty object")
    mappings = value.get("column_mappings", {})
    if projected:
        mappings = projection_of(value["field_projection"], set(columns))
    require(isinstance(mappings, dict) and set(mappings) <= set(columns), "column_mappings must name configured columns")
    for name, mapping in mappings.items():
        closed(mapping, f"column_mappings.{name}", set(SIDES))
        require(all(isinstance(x, str) and x for x in mapping.values()), f"column_mappings.{name} must name source columns")
    keys = texts(value["keys"], "keys", 1) if mode == "keyed" else []
    group_by = texts(value["group_by"], "group_by") if mode == "aggregate" else []
    require({*keys, *group_by} <= set(columns), "every key and group must be a configured column")

    def exact_only(name: str) -> str | None:
        if mode == "keyed":
            return "it is a key" if name in keys else None
        return "measures have the tolerances" if mode == "aggregate" else "multisets have no tolerance"

    fields = {n: Field.of(n, v, exact_only(n), mappings.get(n, {})) for n, v in columns.items()}
    excluded = value.get("excluded_columns", {})
    require(isinstance(excluded, dict) and all(isinstance(x, str) and x for x in (*excluded, *excluded.values())), "excluded_columns must give a reason for each column")
    for i, side in enumerate(SIDES):
        used = [f.sources[i] for f in fields.values()]
        require(len(used) == len(set(used)), f"two columns read the same {side} column")
        require(not set(used) & set(excluded), f"a {side} column is both read and excluded")
    nulls_equal = True
    if mode == "keyed":
        require(value["identity"] == {"null_keys": "reject", "duplicates": "reject"}, "identity must reject null keys and duplicates")
        require(isinstance(value["nulls_equal"], bool), "nulls_equal must be true or false")
        nulls_equal = value["nulls_equal"]
    measures: tuple[Measure, ...] = ()
    if mode == "aggregate":
        require(isinstance(value["measures"], dict) and value["measures"] and all(value["measures"]), "measures must be a nonempty object")
        measures = tuple(Measure.of(n, v, fields) for n, v in value["measures"].items())
    return Recipe(mode, fields, tuple(keys), nulls_equal, tuple(group_by), measures, scope["expected_empty"], output["sensitivity"] == "raw", tuple(delimiters[s] for s in SIDES), tuple(tuple(texts(tokens[s], f"null_tokens.{s}")) for s in SIDES), tuple(excluded), value)


def projection_of(value: Any, columns: set[str]) -> dict[str, dict[str, str]]:
    """Source columns by side of a field projection; selectors of documents are checked.

    Documents are read with their selectors, so their columns have the canonical names.
    """
    closed(value, "field_projection", {"version", *SIDES})
    require(value["version"] == 1, "field_projection.version must be 1")
    out: dict[str, dict[str, str]] = {n: {} for n in columns}
    for side in SIDES:
        where, kind = f"field_projection.{side}", value[side].get("kind") if isinstance(value[side], dict) else None
        require(kind in PROJECTIONS, f"{where}.kind is unknown")
        closed(value[side], where, {"kind", "fields"} | ({"namespaces"} if kind == "xml-field-v1" else set()))
        fields = value[side]["fields"]
        require(isinstance(fields, dict) and set(fields) == columns, f"{where}.fields must name the configured columns")
        texts(list(fields.values()), f"{where}.fields")
        if kind == "json-pointer-v1":
            good = all(re.fullmatch(r"(/([^~/]|~[01])*){1,32}", x) for x in fields.values())
            require(good, f"{where} must have JSON pointers of 1 to 32 tokens")
        if kind == "xml-field-v1":
            name = r"([A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*"
            good = all(re.fullmatch(rf"@{name}|{name}(/{name}){{0,31}}", x, re.ASCII) for x in fields.values())
            require(good, f"{where} must have attributes or paths of 1 to 32 names")
            used = {part.partition(":")[0] for x in fields.values() for part in x.lstrip("@").split("/") if ":" in part}
            require(used == set(value[side]["namespaces"]), f"{where}.namespaces must be those of the selectors")
            paths = [x.split("/") for x in fields.values() if not x.startswith("@")]
            inside = any(a is not b and b[: len(a)] == a for a in paths for b in paths)
            require(not inside, f"{where} has a path within another")
        for n, x in fields.items():
            out[n][side] = x if kind == "direct-v1" else n
    return out


def effective_policy(recipe: Recipe) -> dict:
    """The recipe with every default filled in: what is hashed, explained and locked."""
    src = recipe.source
    out: dict[str, Any] = {
        "schema_version": {"keyed": 1, "aggregate": 2, "multiset": 3}[recipe.mode],
        "recipe_version": src["recipe_version"],
        "comparison_mode": recipe.mode,
        "scope": src["scope"],
        "delimiters": dict(zip(SIDES, recipe.delimiters, strict=True)),
        "null_tokens": {s: list(x) for s, x in zip(SIDES, recipe.null_tokens, strict=True)},
        "excluded_columns": src.get("excluded_columns", {}),
        "output": {"sensitivity": "raw" if recipe.raw else "summary"},
    }
    role = {"keyed": ("key", recipe.keys), "aggregate": ("group_by", recipe.group_by), "multiset": (None, ())}[recipe.mode]
    out["columns"] = {}
    for name, f in recipe.columns.items():
        entry = dict(src["columns"][name]) | {"normalize": list(f.normalize), "comparison": "numeric" if f.tolerance else "exact"}
        entry |= {f"{s}_column": x for s, x in zip(SIDES, f.sources, strict=True)}
        out["columns"][name] = entry | ({role[0]: name in role[1]} if role[0] else {})
    if recipe.mode == "keyed":
        out |= {"identity": src["identity"], "nulls_equal": recipe.nulls_equal}
    elif recipe.mode == "aggregate":
        measures = {n: dict(m) | ({} if m["operator"] == "count" else {"comparison": m.get("comparison", "exact")}) for n, m in src["measures"].items()}
        out |= {"aggregate_contract": "aggregate-v1", "group_by": list(recipe.group_by), "group_nulls": "reject", "measures": measures}
    else:
        out |= {"multiset_contract": "multiset-v1", "canonical_encoding": "typed-length-prefixed-v1", "column_order": sorted(recipe.columns), "nulls_equal": True}
    out |= {x: src[x] for x in ("input_projection", "field_projection") if x in src}
    return out


def explain(recipe: Recipe) -> dict:
    """The effective policy with its fingerprint."""
    return effective_policy(recipe) | {"policy_sha256": recipe.fingerprint}


def check_lock(recipe: Recipe, expected_sha256: str | None) -> None:
    """The gate before any input is opened."""
    require(expected_sha256 in (None, recipe.fingerprint), "the policy is not the locked one")
