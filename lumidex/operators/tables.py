"""Keeping an index table current: difference to a listing, upsert that keeps ids, deletes by path or tree, moves, and partial note changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dir", "name"]


def difference(index: DataFrame, listing: DataFrame) -> DataFrame:
    """dir, name and change: new, changed, gone or same, by size and time."""
    a, b = index.select(*KEY, F.struct("size", "mtime").alias("was")), listing.select(*KEY, F.struct("size", "mtime").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, KEY, "full_outer").select(*KEY, change.alias("change"))


def newest(records: DataFrame) -> DataFrame:
    """One record of each path: that of the latest time, then of the greatest id."""
    rest = [c for c in records.columns if c not in KEY]
    order = F.struct(*[F.col(c) for c in ("mtime", "id") if c in rest], F.xxhash64(*rest).alias("_tie"))
    return records.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("_new")).select(*KEY, "_new.*")


def upsert(index: DataFrame, records: DataFrame) -> DataFrame:
    """Records replace rows of their path, which keep their id; new paths keep the record's id. Of several records of a path the newest counts."""
    records = newest(records)
    old = index.select(*KEY, F.col("id").alias("_id"))
    fresh = records.join(old, KEY, "left").withColumn("id", F.coalesce("_id", "id")).select(index.columns)
    return index.join(records.select(*KEY), KEY, "left_anti").select(index.columns).unionByName(fresh)


def within(root: str) -> Column:
    return (F.col("dir") == root) | ((F.col("dir") >= root + "/") & (F.col("dir") < root + "0"))


def delete_tree(index: DataFrame, root: str) -> DataFrame:
    return index.where(~within(root))


def delete_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select(*KEY), KEY, "left_anti").select(index.columns)


def move(index: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: dir, name, to_dir, to_name. Ids stay; a row at a target gives way."""
    kept = index.join(moves.select(F.col("to_dir").alias("dir"), F.col("to_name").alias("name")), KEY, "left_anti")
    return kept.join(moves, KEY, "left").withColumns({"dir": F.coalesce("to_dir", "dir"), "name": F.coalesce("to_name", "name")}).select(index.columns)


def _says(columns: list[str]) -> Column:
    """Whether a note says anything: stars, a flag, collections or a level set by hand."""
    said = (F.col("rating") > 0) | (F.col("flag") > 0) | (F.size("collections") > 0)
    return said | (F.coalesce("audience", F.lit(0)) > 0) if "audience" in columns else said


def change_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: dir, name, and rating, flag, audience (null: as it was; 0: none), add and drop (arrays of collections, any letter case). Empty notes go.

    The level set by hand, `audience` from 1 to 5, is there if notes or changes have such a column.
    """
    n, c = notes.alias("n"), changes.alias("c")
    own = F.coalesce("n.collections", F.array().cast("array<string>"))
    gone = F.transform(F.coalesce("c.drop", F.array().cast("array<string>")), lambda x: F.lower(x))
    kept = F.filter(own, lambda x: ~F.array_contains(gone, F.lower(x)))
    more = F.filter(F.transform(F.coalesce("c.add", F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: ~F.array_contains(F.transform(kept, lambda y: F.lower(y)), F.lower(x)))
    joined = n.join(c, KEY, "full_outer")
    level = [f"{x}.audience" for x, rows in (("c", changes), ("n", notes)) if "audience" in rows.columns]
    more = F.concat(kept, more).alias("collections")
    out = joined.select(*KEY, F.coalesce("c.rating", "n.rating", F.lit(0)).alias("rating"), F.coalesce("c.flag", "n.flag", F.lit(0)).alias("flag"), more, *([F.least(F.coalesce(*level, F.lit(0)), F.lit(5)).alias("audience")] if level else []))
    return out.where(_says(out.columns))


def prune_notes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes of missing files go, but not those of a folder of which all are missing."""
    there = files.select(*KEY, F.lit(True).alias("there")).distinct()
    seen = notes.join(there, KEY, "left")
    whole = seen.groupBy("dir").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("any_there"))
    return seen.join(whole, "dir").where(F.coalesce("there", F.lit(False)) | ~F.col("any_there")).select(notes.columns)


def replace_notes(notes: DataFrame, folder: str, fresh: DataFrame) -> DataFrame:
    """One folder's notes become the given ones; empty ones aren't kept."""
    return notes.where(F.col("dir") != folder).unionByName(fresh.where((F.col("dir") == folder) & _says(fresh.columns)).select(notes.columns))


def transfer_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes go where their files went (dir, name, to_dir, to_name); one that was there gives way. A file without a note leaves the target's alone."""
    going = notes.join(moves, KEY)
    there = going.select(F.col("to_dir").alias("dir"), F.col("to_name").alias("name")).distinct()
    own = [F.col("to_dir").alias("dir"), F.col("to_name").alias("name"), *[c for c in notes.columns if c not in KEY]]
    stay = notes.join(moves.select(*KEY), KEY, "left_anti").join(there, KEY, "left_anti")
    return stay.select(notes.columns).unionByName(going.select(*own).select(notes.columns))


def forget(index: DataFrame, notes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and notes without some files."""
    return delete_paths(index, paths), notes.join(paths.select(*KEY), KEY, "left_anti").select(notes.columns)


def delete_collection(notes: DataFrame, name: str) -> DataFrame:
    """Notes without a collection in any letter case; notes that say nothing else go."""
    kept = notes.withColumn("collections", F.filter("collections", lambda c: F.lower(c) != name.lower()))
    return kept.where(_says(notes.columns))


def toggled(notes: DataFrame, chosen: DataFrame, column: str, value: int) -> DataFrame:
    """The rating or flag of the chosen files: set, or cleared where all of them have it already. One row tells which, so nothing is collected."""
    now = chosen.select(*KEY).distinct().join(notes.select(*KEY, F.col(column).alias("_was")), KEY, "left")
    every = now.agg(F.bool_and(F.coalesce(F.col("_was") == value, F.lit(False))).alias("_all"))
    other = "flag" if column == "rating" else "rating"
    change = now.crossJoin(F.broadcast(every)).select(*KEY, F.when(F.col("_all"), 0).otherwise(value).cast("int").alias(column), F.lit(None).cast("int").alias(other), F.array().cast("array<string>").alias("add"), F.array().cast("array<string>").alias("drop"))
    return change_notes(notes, change)


def batch_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Many changes at once, of which `at` tells the order: for each path the last rating, flag and audience that isn't null count, and what the last mention of a collection says.

    An unknown flag is an error of the caller: it raises when the job runs.
    """
    checked = changes.withColumn("flag", F.when(F.col("flag").isNull() | F.col("flag").isin(0, 1, 2), F.col("flag")).otherwise(F.raise_error(F.lit("unknown flag")).cast("int")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    marks = checked.groupBy(*KEY).agg(*[last(c) for c in ("rating", "flag", "audience") if c in changes.columns])
    empty = F.array().cast("array<string>")
    said = checked.select(*KEY, "at", F.explode(F.concat(F.transform(F.coalesce("drop", empty), lambda c: F.struct(F.lit(0).alias("on"), c.alias("c"))), F.transform(F.coalesce("add", empty), lambda c: F.struct(F.lit(1).alias("on"), c.alias("c"))))).alias("x"))
    final = said.groupBy(*KEY, F.lower("x.c").alias("k")).agg(F.max_by("x", F.struct("at", "x.on")).alias("x"), F.max("at").alias("at"))
    lists = final.groupBy(*KEY).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("x.on") == on, F.struct("at", "x.c")))), lambda y: y["c"]).alias(n) for n, on in (("add", 1), ("drop", 0))])
    return change_notes(notes, marks.join(lists, KEY, "left"))


def with_levels(rows: DataFrame, notes: DataFrame, level: str) -> DataFrame:
    """The level of each row: the one set by hand where there is one, else the column `level`."""
    own = notes.where("audience > 0").select(*KEY, F.col("audience").alias("_own"))
    return rows.join(own, KEY, "left").withColumn(level, F.coalesce("_own", level)).drop("_own")


def notes_in(notes: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """A folder's notes, or one file's."""
    own = notes.where(F.col("dir") == folder)
    return own if name is None else own.where(F.col("name") == name)


def note_folders(notes: DataFrame) -> DataFrame:
    """Folders that hold notes, and how many."""
    return notes.groupBy("dir").agg(F.count("*").alias("n"))


def reconcile(index: DataFrame, listing: DataFrame, readable: bool = True) -> tuple[DataFrame, DataFrame]:
    """The index after a full listing, and the changes it took; a folder that can't be read leaves the index as it is."""
    if not readable:
        return index, difference(index, index)
    change = difference(index, listing)
    gone = change.where("change = 'gone'").select(*KEY)
    fresh = listing.join(change.where("change in ('new', 'changed')").select(*KEY), KEY, "left_semi")
    return upsert(delete_paths(index, gone), fresh), change


def pending(files: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Files whose content key isn't in the ledger of finished (or failed) ones."""
    return files.join(done.select(key), key, "left_anti")


def changed_files(ledger: DataFrame, now: DataFrame, key: str = "dir") -> DataFrame:
    """Note files to read again: new ones, and those of another time or size."""
    old = ledger.select(key, F.struct("mtime", "size").alias("_was"))
    return now.join(old, key, "left").where(F.col("_was").isNull() | (F.col("_was") != F.struct("mtime", "size"))).drop("_was")


def reloaded(notes: DataFrame, read: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after reading some folders again, and the folders of which anything differs.

    `read` has (dir, readable); what an unreadable folder held is kept, so that it can be tried again. `fresh` has the notes of readable ones.
    """
    done = read.where("readable").select("dir").distinct()
    digest = lambda rows: rows.join(done, "dir", "left_semi").groupBy("dir").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*[F.col(c) for c in notes.columns])).alias("h"))
    old, new = digest(notes).toDF("dir", "n0", "h0"), digest(fresh).toDF("dir", "n1", "h1")
    differs = done.join(old, "dir", "left").join(new, "dir", "left").where(~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("h0").eqNullSafe(F.col("h1")))).select("dir")
    kept = notes.join(differs, "dir", "left_anti").select(notes.columns)
    return kept.unionByName(fresh.join(differs, "dir", "left_semi").select(notes.columns)), differs


def inherited(views: DataFrame, folders: DataFrame) -> DataFrame:
    """(dir, name, query, saved_in): the saved views that apply to each folder, its own and those of all folders above; of one name, in any letter case, the nearest."""
    from .works import ancestors

    up = folders.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "saved_in"))
    found = up.join(views.select(F.col("dir").alias("saved_in"), "name", "query"), "saved_in")
    place = F.row_number().over(Window.partitionBy("dir", F.lower("name")).orderBy("far", "name"))
    return found.withColumn("_place", place).where("_place = 1").select("dir", "name", "query", "saved_in")


def view_counts(rows: DataFrame, views: dict[str, Column]) -> DataFrame:
    """(name, n): how many rows each saved view matches, all in one pass."""
    if not views:
        return rows.sparkSession.createDataFrame([], "name string, n long")
    counts = rows.agg(*[F.count_if(c).alias(f"_{k}") for k, c in enumerate(views.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{k}").alias("n")) for k, n in enumerate(views)])).alias("x")).select("x.*")


def fast_recipe(model: Column, steps: Column, cfg: Column) -> Column:
    """Whether a recipe was made with a model of the fast kind: named so, or, unless it is named raw or base, told by few steps and no guidance (or by neither being told)."""
    words = _name_words(model)
    settings = (F.coalesce(steps, F.lit(8)) <= 12) & (F.coalesce(cfg, F.lit(1.0)) <= 1.5)
    return F.array_contains(words, "turbo") | (~F.array_contains(words, "raw") & ~F.array_contains(words, "base") & settings)


def _name_words(name: Column) -> Column:
    """Words of two letters or more of a model's name, without folders and ending."""
    from ..functions.text import model_key

    return F.array_distinct(F.filter(F.split(model_key(name), r"[^a-z0-9]+"), lambda w: F.length(w) > 1))


def matched_models(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(model, family, fast, file, stand_in) for recipes of (model, family, steps, cfg): the installed file (file, family, format) of that name, else the one of the family most like it, else null.

    Alike means: both or neither of the fast kind (`fast_recipe`), then words in common, then the plain format; of equals the first
    name. Installed files are a dimension: a wanted model meets each file of its family.
    """
    from ..functions.text import model_key

    have = installed.select("file", "family", "format", model_key(F.col("file")).alias("_key"), _name_words(F.col("file")).alias("_w"))
    keys = ["model", "family", "fast"]
    asked = wanted.select("model", "family", fast_recipe(F.col("model"), F.col("steps"), F.col("cfg")).alias("fast")).distinct().withColumn("_key", model_key(F.col("model"))).withColumn("_v", _name_words(F.col("model")))
    exact = asked.join(have.groupBy("_key").agg(F.min("file").alias("file")), "_key").where("_key <> ''").select(*keys, "file", F.lit(False).alias("stand_in"))
    kin = asked.join(exact, keys, "left_anti").join(have.drop("_key"), "family")
    score = F.when(F.array_contains("_w", "turbo") == F.col("fast"), 10.0).otherwise(0.0) + F.size(F.array_intersect("_w", "_v")) + F.when(F.col("format") == "plain", 0.5).otherwise(0.0)
    near = kin.groupBy(*keys).agg(F.min_by("file", F.struct((-score).alias("a"), "file")).alias("file")).withColumn("stand_in", F.lit(True))
    return asked.select(*keys).join(exact.unionByName(near), keys, "left").withColumn("stand_in", F.coalesce("stand_in", F.lit(False)))


def compared(rows: DataFrame, ids: list[int]) -> DataFrame:
    """(setting, values, differs) of a few rows side by side: values in the order of the ids, empty where a row has none; settings nobody has are left out."""
    own = rows.where(F.col("id").isin(ids))
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s_]+", " "))
    item = lambda k, v: F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v"))
    loras = F.array_join(F.transform("loras", lambda x: F.concat_ws(" ", x["name"], x["weight"].cast("string"))), ", ")
    fixed = F.array(item("prompt", F.col("prompt")), item("negative prompt", F.col("negative")), item("model", F.col("model")), item("loras", loras), item("seed", F.col("seed")), item("size", F.concat_ws(" × ", "width", "height")), item("made with", F.col("source")))
    params = F.filter(F.transform("params", lambda p: F.struct(key(p["key"]).alias("k"), p["value"].alias("v"))), lambda p: ~p["k"].isin("seed", "size"))
    each = own.select("id", F.explode(F.concat(fixed, params)).alias("x")).groupBy("x.k", "id").agg(F.min("x.v").alias("v"))
    wide = each.groupBy(F.col("k").alias("setting")).agg(F.map_from_entries(F.collect_list(F.struct("id", "v"))).alias("m"))
    values = F.transform(F.array(*[F.lit(i).cast("long") for i in ids]), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return wide.select("setting", values.alias("values")).where(F.exists("values", lambda v: F.trim(v) != "")).withColumn("differs", F.size(F.array_distinct("values")) > 1)
