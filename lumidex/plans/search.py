"""Searches over the media table: predicates to combine, relevance, scope and order. No text language of its own: predicates are Columns.

Every predicate is false where nothing is known, never null, so `~` is a plain complement;
malformed values match nothing. Where alternatives are listed, any of them will do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import facets as FA
from ..functions import text as T


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def in_prompt(needle: str) -> Column:
    return T.has_word(F.col("prompt"), needle)


def in_negative(needle: str) -> Column:
    return T.has_word(F.col("negative"), needle)


def facet(kind: str, *values: str, exact: bool = False) -> Column:
    """Facets of a kind, of rows with a column `facets` (see `functions.facets.with_facets`). Numbers (steps, cfg) always match whole; `model` includes supporting models."""
    exact = exact or kind in ("steps", "cfg")
    return _any([FA.matches(F.col("facets"), kind, v, exact) for v in values if v.strip()])


def model(*values: str, exact: bool = False) -> Column:
    """Part of the name of any model; with `exact` the whole name."""
    return facet("model", *values, exact=True) if exact else _any([F.contains(T.names_text(F.col("model"), F.col("models")), F.lit(v.lower())) for v in values])


def lora(*values: str, exact: bool = False) -> Column:
    if exact:
        return facet("lora", *values, exact=True)
    joined = F.lower(F.array_join(F.transform("loras", lambda x: x["name"]), " "))
    return _any([F.contains(joined, F.lit(v.lower())) for v in values])


def name(*values: str, exact: bool = False) -> Column:
    own = F.lower("name")
    return _any([own == v.lower() if exact else F.contains(own, F.lit(v.lower())) for v in values])


def seed(*values: str, exact: bool = False) -> Column:
    """The seed from its first digit on, or whole."""
    return F.col("seed").isin(*values) if exact else _any([F.startswith(F.col("seed"), F.lit(v)) for v in values])


def source(*values: str) -> Column:
    return F.lower("source").isin(*[v.lower() for v in values])


def kind(*words: str) -> Column:
    known = {"image": 0, "images": 0, "picture": 0, "pictures": 0, "photo": 0, "still": 0, "video": 1, "videos": 1, "movie": 1, "clip": 1}
    which = sorted({known[w.strip().lower()] for w in words if w.strip().lower() in known})
    return F.col("kind").isin(which) if which else F.lit(False)


def whole_prompt(value: str, column: str = "prompt") -> Column:
    want = " ".join(value.lower().replace('"', "").split())
    return T.same_text(F.col(column)) == want if want else F.lit(False)


def collection(*values: str, exact: bool = False) -> Column:
    """Rows in a collection of which the name holds the value, or is it, in any letter case."""
    own = F.transform("collections", lambda c: F.lower(c))

    def held(v: str) -> Column:
        return F.array_contains(own, v.lower()) if exact else F.exists(own, lambda c: F.contains(c, F.lit(v.lower())))

    return _any([held(v) for v in values])


def folder(root: str, tree: bool = True) -> Column:
    """A folder, or all below it as a range of paths, which file statistics can prune."""
    here = F.col("dir") == root
    return here | ((F.col("dir") >= root + "/") & (F.col("dir") < root + "0")) if tree else here


def dates(first: str, last: str | None = None, zone: str = "UTC") -> Column:
    """Days, months or years (`2024`, `2024-05`, `2024-05-09`) of a time zone, both included, as a range of literals; malformed ones match nothing."""
    try:
        low, _ = _span(first, zone)
        _, high = _span(last or first, zone)
    except (ValueError, KeyError, OverflowError):
        return F.lit(False)
    return (F.col("mtime") >= low) & (F.col("mtime") < high)


def _span(day: str, zone: str) -> tuple[int, int]:
    parts, tz = [int(p) for p in day.split("-")], ZoneInfo(zone) if zone != "UTC" else UTC
    if len(parts) == 1:
        a, b = datetime(parts[0], 1, 1, tzinfo=tz), datetime(parts[0] + 1, 1, 1, tzinfo=tz)
    elif len(parts) == 2:
        a, b = datetime(*parts, 1, tzinfo=tz), datetime(parts[0] + parts[1] // 12, parts[1] % 12 + 1, 1, tzinfo=tz)
    else:
        a = datetime(*parts, tzinfo=tz)
        b = datetime.combine((a + timedelta(days=1)).date(), datetime.min.time(), tzinfo=tz)
    return int(a.timestamp() * 1000), int(b.timestamp() * 1000)


def rated(low: int, high: int = 5) -> Column:
    return F.col("rating").between(low, high)


def unrated() -> Column:
    return F.col("rating") == 0


def flagged(*which: str) -> Column:
    known = {"none": 0, "keep": 1, "reject": 2}
    flags = [known[w] for w in which if w in known]
    return F.col("flag").isin(flags) if flags else F.lit(False)


def duplicates(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose id is among those of duplicate groups."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


ORDERS = {
    "newest": lambda: [F.desc("mtime"), F.desc("name")],
    "oldest": lambda: [F.asc("mtime"), F.asc("name")],
    "name": lambda: [F.asc("dir"), T.ascii_fold(F.col("name")).asc()],
    "name_desc": lambda: [F.desc("dir"), T.ascii_fold(F.col("name")).desc()],
    "size": lambda: [F.desc("size"), F.asc("name")],
    # keep before none before reject within a rating
    "rating": lambda: [F.desc("rating"), F.when(F.col("flag") == 1, 0).when(F.col("flag") == 0, 1).otherwise(2).asc(), F.desc("mtime"), F.desc("name")],
    "taste": lambda: [F.desc_nulls_last("taste"), F.desc("mtime"), F.desc("name")],
}


def searched_names() -> list[Column]:
    """Names that free words find: of the file, of all models, of all LoRAs."""
    return [F.lower("name"), T.names_text(F.col("model"), F.col("models")), F.lower(F.array_join(F.transform("loras", lambda x: x["name"]), "\n"))]


@dataclass
class Search:
    """Predicates, words that rank wherever they stand (`ranked`), words of the prompt that rank there only (`ranked_prompt`), and the order of equals."""

    where: list[Column] = field(default_factory=list)
    ranked: list[str] = field(default_factory=list)
    ranked_prompt: list[str] = field(default_factory=list)
    order: str = "newest"

    def rows(self, media: DataFrame) -> DataFrame:
        """The matching rows, with their score (0 if nothing ranks).

        Places of words are worked out once a row, behind a generator, which keeps later filters from repeating them.
        """
        out, terms = media, [*self.ranked, *self.ranked_prompt]
        for c in self.where:
            out = out.where(c)
        if not terms:
            return out.withColumn("score", F.lit(0.0))
        prompt, negative = F.col("prompt"), F.col("negative")
        names, settings = searched_names(), [T.settings_text(F.col("source"), F.col("seed"), F.col("params"))]
        out = out.withColumn("_at", F.explode(F.array(F.struct(*[T.around(n, prompt).alias(f"w{k}") for k, n in enumerate(terms)]))))
        points = [T.term_score(n, F.col(f"_at.w{k}"), prompt, negative, names, settings) if k < len(self.ranked) else T.term_score(n, F.col(f"_at.w{k}"), prompt, F.lit(""), [], []) for k, n in enumerate(terms)]
        out = out.withColumn("_p", F.explode(F.array(F.array(*points))))
        out = out.where(F.forall("_p", lambda p: p > 0))
        total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p) + T.phrase_bonus(self.ranked, prompt)
        return out.withColumn("score", total).drop("_at", "_p")

    def sorted(self, media: DataFrame) -> DataFrame:
        by = [F.desc("score")] if self.ranked or self.ranked_prompt else []
        return self.rows(media).orderBy(*by, *ORDERS[self.order](), "id")


def placed(rows: DataFrame, by: list[Column], group: str | None = None, spread: int | None = None) -> DataFrame:
    """Adds `place`, the 1-based position in the order `by` (within each `group`), without putting all rows of a group in one task.

    Rows are sorted by ranges; each range counts its rows of every group, and the counts before it
    are added. The driver sees nothing, the counts are `spread` rows for each group at most; by default there are as many
    ranges as shuffle partitions. The rows are written once, when the plan is made.
    """
    spread = spread or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [group] if group else ["_all"]
    rows = rows if group else rows.withColumn("_all", F.lit(0))
    dealt = rows.repartitionByRange(spread, *[F.col(k) for k in own], *by).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)  # both uses below see the same ranges
    counts = dealt.groupBy("_range", *own).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *own).orderBy(*by)))
    out = local.join(before.drop("_n"), ["_range", *own])
    return out.withColumn("place", (F.col("_local") + F.col("_before")).cast("long")).drop("_range", "_local", "_before", "_n", "_all")


def arrivals(now: DataFrame, before: DataFrame, opened_ms: int) -> DataFrame:
    """Rows that the last answer to the same search didn't have and that are no older than five seconds before the folder was opened."""
    return now.where(F.col("mtime") >= opened_ms - 5000).join(before.select("id"), "id", "left_anti")
