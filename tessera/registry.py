"""The function registry, overload sets and combinators.

Everything happens while a plan is built: a registered function gets Values and
gives a Value, and Catalyst sees only the resulting expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arithmetic, casting, complexes, generators, jsonio, strings
from tessera.functions.lifting import elwise, forward_na, map_column, outer, state_elwise
from tessera.operators import arrays, binary, neighborhood, reduce
from tessera.types import Dim, Option, Pattern, from_spark, match, parse, to_spark
from tessera.value import Value, literal

Function = Callable[..., Value]


class Overloads:
    """An overload set: the most specific signature that matches the arguments is called.

    A signature is a list of datashape patterns. One is more specific than
    another if it matches whatever that one matches, and not the other way
    round; two that match with neither more specific are ambiguous.
    """

    def __init__(self, name: str = ""):
        self.name, self.members = name, []

    def overload(self, signature: list[str], f: Function) -> Overloads:
        self.members.append(([parse(s) for s in signature], f))
        return self

    @staticmethod
    def _fits(signature: list, shapes: list) -> bool:
        bound: dict | None = {}
        if len(signature) != len(shapes):
            return False
        for p, s in zip(signature, shapes, strict=True):
            s = s.item if isinstance(s, Option) and not isinstance(p, (Option, Pattern)) else s
            bound = match(p, s, bound)
            if bound is None:
                return False
        return True

    @classmethod
    def _covers(cls, general: list, special: list) -> bool:
        """Whether the general signature matches all that the special one does."""
        return len(general) == len(special) and all(_wider(g, s) for g, s in zip(general, special, strict=True))

    def resolve(self, values: list[Value]) -> Function:
        shapes = [parse(from_spark(v.dtype)) for v in values]
        found = [(sig, f) for sig, f in self.members if self._fits(sig, shapes)]
        if not found:
            raise TypeError(f"{self.name}: no overload for ({', '.join(from_spark(v.dtype) for v in values)})")
        best = [(s, f) for s, f in found if all(self._covers(o, s) for o, _ in found)]
        if len(best) != 1:
            raise TypeError(f"{self.name}: ambiguous call with ({', '.join(from_spark(v.dtype) for v in values)})")
        return best[0][1]

    def __call__(self, *args, **kw) -> Value:
        values = [literal(a) for a in args]
        return self.resolve(values)(*values, **kw)


def _wider(g, s) -> bool:
    if g == s or isinstance(g, Pattern) and g.name == "Any":
        return True
    if isinstance(g, Pattern):
        return not (isinstance(s, Pattern) and s.name == "Any") and not (g.name == "Scalar" and isinstance(s, Dim))
    if isinstance(g, Dim) and isinstance(s, Dim):
        return (g.size == s.size or isinstance(g.size, str) or g.size is None) and _wider(g.item, s.item)
    if isinstance(g, Option) and isinstance(s, Option):
        return _wider(g.item, s.item)
    return False


def compose(first: Function, second: Function, between: str | T.DataType) -> Function:
    """second after first, by way of a given type."""
    if first is None or second is None:
        raise ValueError("compose: two functions are needed")
    return lambda *args: second(casting.assign(first(*args), between, "nocheck"))


def constant(x) -> Function:
    """Whatever the arguments, x."""
    fixed = literal(x)
    return lambda *args, **kw: fixed


def convert(signature: list[str], f: Function) -> Function:
    """f called with its arguments converted to given types."""
    return lambda *args: f(*[casting.assign(a, t) for a, t in zip(args, signature, strict=True)])


def adapt(dtype: str, forward: Function) -> Function:
    """A lazily evaluated view of a value through a function, as a type."""
    return lambda v: casting.assign(forward(literal(v)), dtype, "nocheck")


def _series(f: Callable) -> Callable:
    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    return run


def apply(f: Callable, result: str, *keywords: str, vectorised: bool = False) -> Function:
    """A Python function as a scalar function, lifted over dimensions; the last arguments may be given by keyword.

    A function of Columns needs no Python worker: pass ``vectorised=False`` and
    return a Column. A function of pandas Series runs in Arrow batches
    (``vectorised=True``, scalars only).
    """
    dtype = to_spark(result)
    if vectorised:
        udf = F.pandas_udf(_series(f), dtype)
        return lambda *args: Value(udf(*[literal(a).col for a in args]), dtype)

    def called(*args, **kw) -> Value:
        if set(kw) != set(keywords):
            raise TypeError(f"keywords {sorted(keywords)} are needed, {sorted(kw)} were given")
        fixed = [literal(kw[k]) for k in keywords]
        scalar = elwise(lambda *v: Value(f(*[x.col for x in v]).cast(dtype), dtype))
        return scalar(*args, *fixed)

    return called


def apply_class(cls: type, result: str) -> Callable[..., Function]:
    """A class: constructed with keywords, then called with columns."""
    return lambda **state: apply(cls(**state), result)


def apply_method(owner: object, name: str, result: str) -> Function:
    return apply(getattr(owner, name), result)


def register_udf(spark: SparkSession, name: str, f: Callable, result: str) -> None:
    """A Python function of pandas Series, callable from SQL text."""
    spark.udf.register(name, F.pandas_udf(_series(f), to_spark(result)))


def _field(v: Value, name: str) -> Value:
    return arrays.field_access(v, name)


_FUNCTIONS: dict[str, Function] = {
    name: getattr(arithmetic, name + "_" * (name == "pow"))
    for name in (
        "add bitwise_and bitwise_not bitwise_or bitwise_xor cbrt cos divide equal exp greater greater_equal is_na left_shift less "
        "less_equal logical_and logical_not logical_or logical_xor minus mod multiply not_equal plus pow right_shift sin sqrt subtract "
        "tan total_order assign_na compound_add compound_div"
    ).split()
}
_FUNCTIONS |= {n: getattr(strings, n) for n in strings.__dict__ if n.startswith("string_")}
_FUNCTIONS |= {
    "real": elwise(complexes.real), "imag": elwise(complexes.imag), "conj": elwise(complexes.conj),
    "sum": reduce.sum_, "max": reduce.max_, "min": reduce.min_, "mean": reduce.mean, "all": reduce.all_, "all_equal": reduce.all_equal,
    "any": reduce.any_, "product": reduce.product, "std": reduce.std, "var": reduce.var, "nansum": reduce.nansum, "nanproduct": reduce.nanproduct,
    "nanmax": reduce.nanmax, "nanmin": reduce.nanmin, "nanmean": reduce.nanmean, "nanstd": reduce.nanstd, "nanvar": reduce.nanvar,
    "storage": binary.storage, "replace_dtype": binary.replace_dtype, "fft2": binary.fft2, "encode": strings.encode, "decode": strings.decode,
    "field_access": _field, "access": _field, "index": arrays.index, "take": arrays.take, "sort": arrays.sort, "unique": arrays.unique,
    "binary_search": arrays.binary_search, "concatenate": arrays.concatenate, "reshape": arrays.reshape, "permute": arrays.permute,
    "transpose": arrays.transpose, "rotate": arrays.rotate, "new_axis": arrays.new_axis, "equals_exact": arrays.equals_exact,
    "view": arrays.identity, "dereference": arrays.identity, "copy": casting.copy, "eval": arrays.identity, "to_host": arrays.identity,
    "assign": casting.assign, "cast": casting.cast, "range": generators.range_, "linspace": generators.linspace,
    "uniform": generators.uniform, "limits.min": generators.limits_min, "limits.max": generators.limits_max,
    "parse_json": jsonio.parse_json, "validate_json": jsonio.validate_json, "format_json": jsonio.format_json,
    "serialize": binary.serialize, "byteswap": binary.byteswap, "fft": binary.fft, "ifft": binary.ifft, "rfft": binary.rfft,
    "conv": neighborhood.convolve, "empty": generators.empty, "zeros": generators.zeros, "ones": generators.ones,
    "elwise": elwise, "outer": outer, "forward_na": forward_na, "compose": compose, "constant": constant, "convert": convert, "adapt": adapt,
    "where": arrays.where, "reduction": reduce.reduction, "left_compound": reduce.left_compound, "right_compound": reduce.right_compound,
    "neighborhood": neighborhood.neighborhood, "state_elwise": state_elwise, "map_column": map_column,
}




def _first(f: Function) -> Function:
    """f with a plain first argument made a Value."""

    def called(v, *args, **kw) -> Value:
        return f(literal(v), *args, **kw)

    return called


for _name in (
    "field_access access index take sort unique binary_search reshape permute transpose rotate new_axis format_json validate_json "
    "serialize byteswap fft ifft rfft fft2 conv storage replace_dtype encode decode"
).split():
    _FUNCTIONS[_name] = _first(_FUNCTIONS[_name])
for _name in ("concatenate", "equals_exact"):
    _FUNCTIONS[_name] = (lambda f: lambda a, b: f(literal(a), literal(b)))(_FUNCTIONS[_name])
_FUNCTIONS["parse_json"] = lambda shape, text: jsonio.parse_json(shape, literal(text))


def get(name: str) -> Function:
    if name not in _FUNCTIONS:
        raise KeyError(f"no function is registered as {name!r}")
    return _FUNCTIONS[name]


def insert(name: str, f: Function) -> None:
    if name in _FUNCTIONS:
        raise ValueError(f"{name!r} is registered already")
    _FUNCTIONS[name] = f


def observe() -> dict[str, Function]:
    """All registered functions, by name."""
    return dict(_FUNCTIONS)


def with_value(v: Value, f: Callable[[Column], object]):
    """Call a Python function with the column of a value."""
    return f(v.col)
