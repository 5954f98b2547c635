"""Facets of a media row: kind, key (lower case), value as written, role; and what matches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Kinds that usage counts, in the order they are reported.
COUNTED = ("model", "lora", "aux", "sampler", "scheduler", "steps", "cfg", "size", "source")
#: Settings by the names they are written under.
SETTINGS = {"sampler": ("sampler",), "scheduler": ("scheduler",), "steps": ("steps",), "cfg": ("cfg", "cfg scale")}


def _facet(kind: str, value: Column, role: Column | None = None) -> Column:
    shown = T.facet_value(F.lit(kind), value)
    return F.struct(F.lit(kind).alias("kind"), F.lower(shown).alias("key"), shown.alias("value"), (F.lit("") if role is None else role).alias("role"))


def _setting(params: Column, kind: str, names: tuple[str, ...]) -> Column:
    return F.transform(F.filter(params, lambda p: F.lower(p["key"]).isin(*names)), lambda p: _facet(kind, p["value"]))


def main_models() -> Column:
    """The facets of a row's main models alone, as `facets` gives them first."""
    return F.array_distinct(F.filter(F.transform(F.filter("models", lambda m: m["kind"] == "main"), lambda m: _facet("model", m["name"])), lambda f: f["value"] != ""))


def facets() -> Column:
    """All facets of a row's models, loras, params, size and source, each once."""
    models, loras, params = F.col("models"), F.col("loras"), F.col("params")
    weight = lambda x: F.concat(x["name"], F.lit("@"), T.number_text(F.round(x["weight"], 2)))
    parts = [
        F.transform(F.filter(models, lambda m: m["kind"] == "main"), lambda m: _facet("model", m["name"])),
        F.transform(F.filter(models, lambda m: m["kind"] != "main"), lambda m: _facet("aux", m["name"], m["kind"])),
        F.transform(loras, lambda x: _facet("lora", x["name"])),
        F.transform(F.filter(loras, lambda x: x["weight"].isNotNull() & ~F.isnan(x["weight"])), lambda x: _facet("loraw", weight(x))),
    ]
    parts += [_setting(params, kind, names) for kind, names in SETTINGS.items()]
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    parts.append(F.array(_facet("size", F.when(sized, F.concat_ws("x", "width", "height")).otherwise("")), _facet("source", F.col("source"))))
    return F.array_distinct(F.filter(F.concat(*parts), lambda f: f["value"] != ""))


def with_facets(rows: DataFrame) -> DataFrame:
    """Rows with a column `facets`, worked out once a row: it stands behind a generator, which keeps predicates on it from repeating it."""
    return rows if "facets" in rows.columns else rows.withColumn("facets", F.explode(F.array(facets())))


def matches(found: Column, kind: str, needle: str, exact: bool = False) -> Column:
    """Whether a facet of the kind has the value, or holds it; `model` looks at supporting models too."""
    kinds = ("model", "aux") if kind == "model" else (kind,)
    want = normal(kind, needle)
    return F.exists(found, lambda f: f["kind"].isin(*kinds) & (f["key"] == want if exact else F.contains(f["key"], F.lit(want))))


def first(found: Column, kind: str) -> Column:
    """The value of the first facet of a kind, null without one."""
    return F.get(F.transform(F.filter(found, lambda f: f["kind"] == kind), lambda f: f["key"]), F.lit(0))


def normal(kind: str, value: str) -> str:
    """The normal form of a value that is searched for, as `functions.text.facet_value` gives it for columns."""
    plain = " ".join(value.replace('"', "").split())
    if kind in ("steps", "cfg"):
        try:
            plain = f"{float(plain):.6f}".rstrip("0").rstrip(".")
        except ValueError:
            pass
    elif kind == "size":
        for sign in "×*X":
            plain = plain.replace(sign, "x")
        plain = plain.replace(" ", "")
    return plain.lower()
